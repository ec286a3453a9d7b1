"""Standardisation by chunks: context units in reading order, chunk plans within a budget, checks and review of standardised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.text import oversized_parts, rendered
from ..operators.folds import chunk_texts, pack_units
from ..operators.labels import with_labels
from ..operators.ledger import ORG, PARTY
from .quality import item

#: Context sheets in order of priority.
CONTEXT_SHEETS = ("PDF_Page_Text", "PDF_Text_Lines", "PDF_Tables_Raw", "PDF_Text_Blocks")
UNIT_ORDER = ["ledger_role", "source_file_name", "page_number", "sheet_rank", "line_order", "row_order", "part"]


def context_units(rows: DataFrame, cells: list[str]) -> DataFrame:
    """rows: pair_id, sheet_name, ledger_role, source_file_name, page_number, line_order, row_order and the cells to show. One text unit a row."""
    rank = F.lit(len(CONTEXT_SHEETS))
    for i, name in enumerate(CONTEXT_SHEETS):
        rank = F.when(F.col("sheet_name") == name, i).otherwise(rank)
    text = lambda c: C.text_or_empty(F.col(c))
    page = F.coalesce(F.col("page_number"), F.lit(0))
    line = F.coalesce("line_order", "row_order")
    header = F.concat(F.lit("["), F.col("sheet_name"), F.lit("] ledger_role="), text("ledger_role"), F.lit(" source_file="), text("source_file_name"), F.lit(" page="), page.cast("string"), F.lit(" order="), line.cast("string"))
    known = rows.where(F.col("sheet_name").isin(*CONTEXT_SHEETS))
    return known.select("pair_id", "sheet_name", text("ledger_role").alias("ledger_role"), text("source_file_name").alias("source_file_name"), page.alias("page_number"), rank.alias("sheet_rank"), line.alias("line_order"), "row_order", F.concat(header, F.lit("\n"), rendered(*[F.col(c) for c in cells])).alias("text"))


def unit_header(c: Column) -> Column:
    """Metadata back from a unit's first line."""
    at = lambda i: F.regexp_extract(c, r"^\[([^\]]*)\] ledger_role=(\S*) source_file=(.*) page=(\d+) order=(\d+)", i)
    return F.struct(at(1).alias("sheet_name"), at(2).alias("ledger_role"), at(3).alias("source_file_name"), at(4).try_cast("int").alias("page_number"), at(5).try_cast("int").alias("line_order"))


def plan_chunks(units: DataFrame, budget: int) -> DataFrame:
    """Chunks of each pair within the budget of characters; a longer unit is split first. Chunk id, pages, roles, files, text."""
    parts = units.select(*[c for c in units.columns if c != "text"], F.posexplode(oversized_parts(F.col("text"), budget)).alias("part", "text"))
    packed = pack_units(parts, budget, ["pair_id"], UNIT_ORDER)
    chunks = chunk_texts(packed, ["pair_id"], UNIT_ORDER, page="page_number")
    names = packed.groupBy("pair_id", "chunk_no").agg(F.array_join(F.array_sort(F.collect_set(F.nullif("ledger_role", F.lit("")))), " | ").alias("source_ledger"), F.array_sort(F.collect_set(F.nullif("source_file_name", F.lit("")))).alias("source_files"))
    return chunks.join(names, ["pair_id", "chunk_no"])


def sheet_text(rows: DataFrame, group: list[str], order: str, cells: list[str], cap: int = 400) -> DataFrame:
    """A view of each group's first `cap` rows as piped lines under a header, with a note of how many more there are."""
    w = Window.partitionBy(*group)
    r = rows.withColumns({"__n": F.row_number().over(w.orderBy(order)), "__all": F.count("*").over(w)}).where(F.col("__n") <= cap)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__n", rendered(*[F.col(c) for c in cells]).alias("t")))), lambda x: x["t"])
    more = F.max("__all") - cap
    body = F.concat_ws("\n", F.lit(" | ".join(cells)), F.array_join(lines, "\n"))
    return r.groupBy(*group).agg(F.when(more > 0, F.concat(body, F.lit("\n... ("), more.cast("string"), F.lit(" more rows omitted from sheet view)"))).otherwise(body).alias("sheet_text"))


def flagged(rows: DataFrame) -> DataFrame:
    """Standardised rows with missing page, text or an unreadable date flagged; earlier reasons stay first."""
    day = F.coalesce(C.iso_date(F.col("transaction_date")), C.parse_date(F.col("transaction_date")))
    own = {"missing source_page": F.col("source_page").isNull(), "empty raw_text": C.is_blank(F.col("raw_text")), "unparseable transaction_date": ~C.is_blank(F.col("transaction_date")) & day.isNull()}
    new = C.joined_reasons(*[F.when(cond, F.lit(text)) for text, cond in own.items()])
    reason = F.array_join(F.filter(F.array(C.strip(F.col("review_reason")), new), lambda x: x != ""), "; ")
    return rows.withColumns({"new_reasons": new, "review_required": F.coalesce("review_required", F.lit(False)) | (new != ""), "review_reason": reason})


def balance_presence(balances: DataFrame) -> DataFrame:
    """Whether each role of a pair has an opening and a closing balance."""
    has = lambda r, k: F.coalesce(F.max((F.col("ledger_role") == r) & (F.col("balance_kind") == k)), F.lit(False))
    return balances.groupBy("pair_id").agg(*[has(r, k).alias(f"{p}_{k}") for r, p in ((ORG, "org"), (PARTY, "party")) for k in ("OpeningBalance", "ClosingBalance")])


def checks(rows: DataFrame, balances: DataFrame) -> DataFrame:
    """rows: of flagged(). Check rows of each pair."""
    n = lambda role, text: F.count_if((F.col("ledger_role") == role) & F.col("new_reasons").contains(text))
    names = {"source_page_present": "missing source_page", "raw_text_present": "empty raw_text", "transaction_date_parses": "unparseable"}
    agg = rows.groupBy("pair_id").agg(F.count("*").alias("n"), *[n(r, t).alias(f"{p}_{k}") for r, p in ((ORG, "org"), (PARTY, "party")) for k, t in names.items()])
    wide = agg.join(balance_presence(balances), "pair_id", "left").na.fill(False)
    ok = lambda c: F.when(c, "PASS").otherwise("REVIEW")
    out = [item("canonical_type_approved", "PASS", F.col("n"), "all rows")]
    for p in ("org", "party"):
        out += [item(k, ok(F.col(f"{p}_{k}") == 0), F.col(f"{p}_{k}"), p) for k in names]
        out += [item(f"{k}_present", ok(F.col(f"{p}_{k}")), F.col(f"{p}_{k}").cast("int"), p) for k in ("OpeningBalance", "ClosingBalance")]
    return wide.select("pair_id", F.explode(F.array(*out)).alias("c")).select("pair_id", "c.*")


def review_rows(rows: DataFrame, balances: DataFrame) -> DataFrame:
    """Transactions and balances under review, one queue."""
    tx = rows.where("review_required").select("pair_id", F.lit("transaction").alias("item_kind"), "ledger_role", "source_page", "raw_type", "canonical_type", "review_reason", "raw_text")
    b = balances.where("review_required").select("pair_id", F.lit("balance").alias("item_kind"), "ledger_role", "source_page", F.col("balance_kind").alias("raw_type"), F.col("balance_kind").alias("canonical_type"), "review_reason", F.col("source_text").alias("raw_text"))
    return tx.unionByName(b)


def type_agreement(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """For each raw type the proposed label of its first row, the local label, and whether they agree."""
    first = rows.select(C.text_or_empty(F.col("raw_type")).alias("raw_type"), "canonical_type", order).groupBy("raw_type").agg(F.min_by("canonical_type", order).alias("proposed_type"))
    local = with_labels(first)
    return local.select("raw_type", "proposed_type", "type_label", "match_method", "type_confidence", "matched_alias", F.col("proposed_type").eqNullSafe(F.col("type_label")).alias("agreement"), "type_review", "type_reason")


def merged_layout(stats: DataFrame) -> DataFrame:
    """stats: pair_id, ledger_role, pos, headers (array), strategies (map of counts). Headers once in first order, counts added up."""
    key = ["pair_id", "ledger_role"]
    heads = stats.select(*key, "pos", F.posexplode("headers").alias("i", "h")).groupBy(*key, "h").agg(F.min(F.struct("pos", "i")).alias("at"))
    ordered = heads.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]).alias("headers"))
    sums = stats.select(*key, F.explode("strategies").alias("k", "v")).groupBy(*key, "k").agg(F.sum("v").alias("v")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("strategies"))
    return ordered.join(sums, key, "full_outer")


def run_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("pairs"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") != "succeeded").alias("failed"))


def lowest_page(pages: DataFrame) -> DataFrame:
    """The least certain page of each ledger; the first of equals."""
    return pages.groupBy("pair_id", "ledger_role").agg(F.min_by("page_number", F.struct("confidence_score", "page_number")).alias("page_number"), F.min("confidence_score").alias("confidence_score"))


#: Fields of a standardised row, of a balance, and of a whole reply, with their types.
ROW = {
    "source_file": "string", "source_page": "int", "source_row_number": "int", "ledger_role": "string", "party_name": "string", "ledger_period_start": "string", "ledger_period_end": "string", "transaction_date": "string", "raw_type": "string",
    "canonical_type": "string", "type_match_method": "string", "type_match_score": "double", "voucher_or_bill_no": "string", "reference_no": "string", "account_or_particulars": "string", "narration": "string", "debit": "double", "credit": "double",
    "net_amount": "double", "balance": "double", "balance_side": "string", "extraction_confidence": "double", "review_required": "boolean", "review_reason": "string", "raw_text": "string", "extraction_method": "string",
}
BALANCE = {
    "balance_kind": "string", "ledger_role": "string", "source_file_name": "string", "amount": "double", "balance_side": "string", "date_or_period": "string", "source_page": "int", "source_text": "string", "found_location": "string", "confidence": "double",
    "review_required": "boolean", "review_reason": "string",
}
REPLY = {"pair_id": "string", "detected_org_name": "string", "detected_party_name": "string", "detected_account_name": "string", "detected_period_start": "string", "detected_period_end": "string"}
LISTS = {"opening_closing_balances": BALANCE, "org_ledger_rows": ROW, "party_ledger_rows": ROW, "uncertain_fields": "string", "extraction_warnings": "string"}
REQUIRED = {"ledger_role", "canonical_type", "balance_kind", "pair_id"}
BALANCE_KINDS = ("OpeningBalance", "ClosingBalance")
_KINDS = {"string": str, "int": int, "double": (int, float), "boolean": bool}
ASKED = "pair_id string, chunk_no int, chunk_id string, source_ledger string, page_range string, input_char_count int, ai_status string, validation_status string, error_message string, reply string"


def reply_problem(text: str, labels) -> str:
    """What is wrong with a reply: its form, unknown or missing fields, types, labels. Empty if it may be used."""
    import json

    def of(value, fields, where):
        if not isinstance(value, dict):
            return f"{where} is not an object"
        for k, v in value.items():
            if k not in fields:
                return f"{where} has an unknown field {k}"
            if v is not None and (not isinstance(v, _KINDS[fields[k]]) or (isinstance(v, bool) and fields[k] != "boolean")):
                return f"{where}.{k} is not a {fields[k]}"
        for k in sorted(REQUIRED & set(fields)):
            if value.get(k) is None:
                return f"{where} lacks {k}"
        if "canonical_type" in fields and value["canonical_type"] not in labels:
            return f"{where}.canonical_type '{value['canonical_type']}' is not an approved label"
        if "balance_kind" in fields and value["balance_kind"] not in BALANCE_KINDS:
            return f"{where}.balance_kind is not an approved kind"
        return ""

    if not (text or "").strip():
        return "empty output"
    try:
        data = json.loads(text)
    except ValueError as e:
        return f"not valid JSON: {e}"
    if not isinstance(data, dict):
        return "not an object"
    problem = of({k: v for k, v in data.items() if k not in LISTS}, REPLY, "reply")
    for name, fields in LISTS.items():
        for i, item in enumerate(own if isinstance(own := data.get(name, []), list) else [None]):
            if problem:
                return problem
            where = f"{name}[{i}]"
            problem = of(item, fields, where) if isinstance(fields, dict) else "" if isinstance(item, str) else f"{where} is not a string"
    return problem


def ask(chunks: DataFrame, instructions: str, complete, max_input_chars: int, labels, dry_run: bool = False) -> DataFrame:
    """ASKED: one request a chunk through complete(text) -> reply, in the order of each pair's chunks. The first bad chunk ends its pair; later ones stay pending.

    Pairs do not wait for each other. The request is the instructions, the chunk's place and its text."""
    import pandas as pd

    names = [c.split()[0] for c in ASKED.split(", ")]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_no")
        out, failed = [], False
        for r in rows.itertuples():
            text = f"{instructions}\npair_id: {r.pair_id}\nchunk: {r.chunk_id} of {len(rows)}\nledgers: {r.source_ledger}\npages: {r.page_range}\n\n{r.context_text}"
            own = [r.pair_id, r.chunk_no, r.chunk_id, r.source_ledger, r.page_range, len(text)]
            if len(text) > max_input_chars:
                out.append([*own, "failed", "skipped", "request is over the character budget", None])
                failed = True
            elif failed or dry_run:
                out.append([*own, "planned" if dry_run else "pending", "skipped" if dry_run else "pending", "", None])
            else:
                try:
                    reply = complete(text)
                except Exception as e:  # any fault of the transport is this chunk's audit row
                    out.append([*own, "failed", "skipped", f"{type(e).__name__}: {e}", None])
                    failed = True
                    continue
                problem = reply_problem(reply, labels)
                out.append([*own, "success", "fail" if problem else "pass", problem, reply])
                failed = bool(problem)
        return pd.DataFrame(out, columns=names)

    return chunks.groupBy("pair_id").applyInPandas(fold, ASKED)


def run(units: DataFrame, instructions: str, complete, max_input_chars: int, labels, dry_run: bool = False) -> dict[str, DataFrame]:
    """Context units to merged results: chunk_audit, log, rows, balances, names. Pairs with a bad chunk give no rows. units: of context_units()."""
    from ..sources.durable import durable
    from ..sources.files import distinct_balances, merged_results

    room = max_input_chars - len(instructions) - 400
    if room < 500:
        raise ValueError("the instructions leave no room for context")
    allowed = [*labels, "Unknown"]
    asked = durable(ask(plan_chunks(units, room), instructions, complete, max_input_chars, allowed, dry_run))
    good = asked.groupBy("pair_id").agg(F.bool_and(F.col("validation_status") == "pass").alias("ok")).where("ok").select("pair_id")
    replies = asked.join(good, "pair_id", "left_semi")
    one = lambda fields: ", ".join(f"{k}: {t}" for k, t in fields.items())
    schema = ", ".join([*[f"{k} {t}" for k, t in REPLY.items()], *[f"{k} array<{'struct<' + one(f) + '>' if isinstance(f, dict) else f}>" for k, f in LISTS.items()]])
    data = replies.select(F.col("pair_id").alias("pair"), "chunk_no", "chunk_id", F.length("reply").alias("chars"), F.from_json("reply", schema).alias("d"))
    listed = lambda name: F.coalesce(F.col(f"d.{name}"), F.array())
    rows = data.select(F.col("pair").alias("pair_id"), "chunk_no", F.posexplode(F.concat(listed("org_ledger_rows"), listed("party_ledger_rows"))).alias("row_no", "r")).select("pair_id", "chunk_no", "row_no", "r.*")
    rows = rows.withColumns({"row_no": F.col("chunk_no") * 1_000_000 + F.col("row_no"), "review_required": F.coalesce("review_required", F.lit(False))})
    balances = data.select(F.col("pair").alias("pair_id"), "chunk_no", F.explode(listed("opening_closing_balances")).alias("b")).select("pair_id", "chunk_no", "b.*").withColumn("review_required", F.coalesce("review_required", F.lit(False)))
    merged = merged_results(data.select(F.col("pair").alias("pair_id"), "chunk_no", F.coalesce("d.detected_org_name", "d.detected_party_name").alias("detected_name"), listed("extraction_warnings").alias("warnings")))
    say = lambda stage, detail: F.struct(F.lit(stage).alias("stage"), detail.alias("detail"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    prompts = asked.select("pair_id", "chunk_no", say("prompt", text(F.col("chunk_id"), ": total_chars=", F.col("input_char_count").cast("string"))).alias("x"))
    parsed = data.select(F.col("pair").alias("pair_id"), "chunk_no", F.explode(F.array(say("response", text(F.col("chunk_id"), ": response_chars=", F.col("chars").cast("string"))), say("parsed", text(F.col("chunk_id"), ": org_rows=", F.size(listed("org_ledger_rows")).cast("string"), ", party_rows=", F.size(listed("party_ledger_rows")).cast("string"), ", balances=", F.size(listed("opening_closing_balances")).cast("string"))))).alias("x"))
    log = prompts.unionByName(parsed).select("pair_id", "chunk_no", "x.*")
    return {"chunk_audit": asked.drop("reply", "chunk_no"), "log": log, "rows": rows, "balances": distinct_balances(balances).drop("chunk_no"), "names": merged}
