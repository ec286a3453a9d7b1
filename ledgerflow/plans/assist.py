"""Proposals made elsewhere (a model, a person) and the deterministic rules that accept or reject them. Nothing here calls a network."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators.labels import TYPE_LABELS, normalized_type
from ..operators.ledger import PARTY, date_ambiguous, unknown_transactions

ACCEPT = 70.0


@dataclasses.dataclass(frozen=True)
class Settings:
    """Gates and limits. Assistance is off unless it is enabled, and hosted providers need approval."""

    enabled: bool = False
    hosted: bool = True
    approved: bool = False
    base_url: str = ""
    model: str = ""
    max_input_chars: int = 12_000
    max_output_tokens: int = 1024
    timeout_s: float = 120.0
    retries: int = 2

    @classmethod
    def from_env(cls, env) -> Settings:
        """Values of the right type are taken from LEDGERFLOW_<NAME>; others keep the default."""
        out = {}
        for f in dataclasses.fields(cls):
            text = env.get(f"LEDGERFLOW_{f.name.upper()}", "").strip()
            if not text:
                continue
            kind = type(f.default)
            try:
                out[f.name] = text.lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
            except ValueError:
                continue
        return cls(**out)

    def allowed(self) -> bool:
        return self.enabled and bool(self.base_url) and bool(self.model) and (not self.hosted or self.approved)


def complete(settings: Settings, payload: dict, send: Callable[[dict], tuple[int, str]], sleep=time.sleep) -> str:
    """One request through `send` (status, body), behind the gate and the size limit; retries on 408, 429 and 5xx with doubling waits up to 8 s."""
    if not settings.allowed():
        raise PermissionError("assistance is not allowed by the settings")
    if len(json.dumps(payload)) > settings.max_input_chars:
        raise ValueError("payload is over the character budget")
    for attempt in range(settings.retries + 1):
        status, body = send(payload)
        if status < 400:
            return body
        if not (status in (408, 429) or status >= 500) or attempt == settings.retries:
            raise RuntimeError(f"provider answered {status}")
        sleep(min(2**attempt, 8))
    raise AssertionError


def probe(settings: Settings, send: Callable[[dict], tuple[int, str]]) -> tuple[bool, str]:
    """Whether a provider answers, and why not: one request without content of ours, no retries, never an exception."""
    if not settings.allowed():
        return False, "not allowed by the settings"
    ask = {"model": settings.model, "messages": [{"role": "user", "content": 'Reply with {"ok": true}'}], "max_tokens": 16}
    try:
        status, body = send(ask)
        if status >= 400:
            return False, f"provider answered {status}"
        found = body[body.index("{") : body.rindex("}") + 1]
        return (True, "") if json.loads(found).get("ok") is True else (False, "unexpected reply")
    except Exception as e:  # any fault means: not available
        return False, type(e).__name__


def failed_rows(ledger: DataFrame, cap: int = 20, role: str = PARTY) -> DataFrame:
    """Rows with an unclear date, the first `cap` a pair: what a repair request may hold."""
    w = Window.partitionBy("pair_id").orderBy("page_number", "source_row_number", "row_id")
    return date_ambiguous(ledger.where(F.col("ledger_role") == role)).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def apply_date_repairs(ledger: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals: row_id, proposed_date, proposed_confidence, explanation. A date is taken at 70 or more unless the raw date parses, just as surely, to another."""
    p = proposals.select("row_id", "proposed_date", F.col("proposed_confidence").cast("double").alias("pc"), C.text_or_empty(F.col("explanation")).alias("px")).withColumn("asked", F.lit(True)).dropDuplicates(["row_id"])
    r = ledger.join(p, "row_id", "left")
    iso = F.coalesce(C.iso_date(F.col("proposed_date")), C.parse_date(F.col("proposed_date")))
    raw, sure = C.parse_date(F.col("raw_date")), C.date_confidence(F.col("raw_date")) >= ACCEPT
    why = F.when(F.col("asked").isNull(), None).when(F.col("ledger_role") != PARTY, "Row is not of the party ledger.").when(iso.isNull(), "Proposed date is not a date.").when(F.coalesce(F.col("pc"), F.lit(0.0)) < ACCEPT, "Confidence below the threshold.").when(raw.isNotNull() & sure & (raw != iso), "Conflicts with the parsed source date.")
    ok = F.col("asked").isNotNull() & why.isNull()
    cleaned = C.without_reasons(F.col("review_reason"), "date")
    return r.withColumns({"ai_repair_rejection_reason": F.coalesce(why, F.lit("")), "ai_repair_rejected": why.isNotNull(), "ai_repair_applied": ok, "normalized_date": F.when(ok, iso.cast("string")).otherwise(F.col("normalized_date")), "ai_repair_explanation": F.when(ok, F.col("px")).otherwise(""), "ai_repair_date_confidence": F.when(ok, F.col("pc")), "review_reason": F.when(ok, cleaned).otherwise(F.col("review_reason")), "review_flag": F.when(ok, F.lit(True)).otherwise(F.col("review_flag"))}).drop("asked", "pc", "px", "proposed_date")


def unknown_evidence(ledger: DataFrame, samples: int = 2) -> DataFrame:
    """Unknown raw types with a few sample contexts: what a grouping request may hold."""
    u = unknown_transactions(ledger).withColumn("norm", normalized_type(F.col("raw_type")))
    w = Window.partitionBy("pair_id", "norm").orderBy("page_number", "source_row_number", "row_id")
    few = u.withColumns({"__n": F.row_number().over(w), "n_rows": F.count("*").over(Window.partitionBy("pair_id", "norm"))}).where(F.col("__n") <= samples)
    return few.groupBy("pair_id", "norm").agg(F.max("n_rows").alias("row_count"), F.transform(F.array_sort(F.collect_list(F.struct("__n", F.substring(C.first_filled(F.col("particulars"), F.col("raw_text")), 1, 160).alias("t")))), lambda x: x["t"]).alias("samples"))


def apply_label_suggestions(ledger: DataFrame, suggestions: DataFrame, labels=None) -> DataFrame:
    """suggestions: raw_type, suggested_label, confidence, reason. A known label at 70 or more is applied to unknown rows; others stay for review."""
    s = suggestions.select(normalized_type(F.col("raw_type")).alias("__norm"), "suggested_label", F.col("confidence").cast("double").alias("sc"), C.text_or_empty(F.col("reason")).alias("sr")).dropDuplicates(["__norm"])
    r = ledger.withColumn("__norm", normalized_type(F.col("raw_type"))).join(s, "__norm", "left").drop("__norm")
    unknown = (F.col("record_kind") == C.TRANSACTION) & (F.col("type_label") == "Unknown") & F.col("suggested_label").isNotNull()
    known = F.col("suggested_label").isin(*(labels or TYPE_LABELS)) & (F.coalesce("sc", F.lit(0.0)) >= ACCEPT)
    cleaned = C.without_reasons(F.col("review_reason"), r"unmatched|type could not|low confidence")
    return r.withColumns({"ai_label_suggested": F.when(unknown, F.col("suggested_label")).otherwise(""), "ai_label_confidence": F.when(unknown, F.col("sc")), "ai_label_reason": F.when(unknown, F.col("sr")).otherwise(""), "ai_label_applied": unknown & known, "ai_label_rejected": unknown & ~known, "review_reason": F.when(unknown & known, cleaned).otherwise(F.col("review_reason")), "type_label": F.when(unknown & known, F.col("suggested_label")).otherwise(F.col("type_label"))}).drop("suggested_label", "sc", "sr")
