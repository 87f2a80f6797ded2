"""Anchors from a claim to the exact words that bear it: built once, resolved against later versions of a document.

Places are counted in characters. A block has a text and, where its conversion kept them, places on pages (prov: page_no and
bbox); only a block of one such place tells where a quote stands, so one of none or several is no ground for an anchor, and a
quote found there later counts as found in the block alone. All of it are joins and expressions; only the places of quotes in a
block are found in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.semantics import python_strip

CONTEXT = 32
_ALNUM = r"[\p{L}\p{N}]"


def find_all(text: str, part: str) -> list[int]:
    """All places, overlapping ones too."""
    out, k = [], text.find(part) if part else -1
    while k >= 0:
        out.append(k)
        k = text.find(part, k + 1)
    return out


def aligned(text: str, start: int, end: int) -> bool:
    """Neither edge cuts a word."""
    left = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    right = end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    return not (left or right)


def _cuts(quote: Column, before: Column, after: Column) -> Column:
    """Whether a quote begins or ends within a word, by the texts before and after it."""
    at = lambda c, k: F.coalesce(F.substring(c, k, F.lit(1)).rlike(_ALNUM), F.lit(False))
    left = (F.length(before) > 0) & at(before, F.length(before)) & at(quote, F.lit(1))
    right = (F.length(after) > 0) & at(after, F.lit(1)) & at(quote, F.length(quote))
    return left | right


def _n_prov(blocks: DataFrame) -> Column:
    return F.coalesce(F.size("prov"), F.lit(0)) if "prov" in blocks.columns else F.lit(1)


def _placed(blocks: DataFrame) -> DataFrame:
    """blocks with n_prov, and page_no and bbox where there is one place; without a column prov, page_no as it is."""
    if "prov" in blocks.columns:
        one = F.when(F.size("prov") == 1, F.element_at("prov", 1))
        return blocks.withColumns({"n_prov": _n_prov(blocks), "page_no": one["page_no"], "bbox": F.to_json(one["bbox"])})
    page = F.col("page_no") if "page_no" in blocks.columns else F.lit(None).cast("int")
    return blocks.withColumns({"n_prov": F.lit(1), "page_no": page, "bbox": F.lit(None).cast("string")})


def _looked_up(context: int):  # noqa: ANN202
    """For mapInArrow: of each row's claims, where their quotes stand first in its text (from 0, -1 if nowhere), whether they stand there
    again, overlapping or not, and what is around the first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                found: list[list[list]] = [[], [], [], []]
                for text, claims in zip(rows.column("_text"), rows.column("_claims")):
                    text, quotes = text.as_py() or "", [q or "" for q in claims.values.field("quote").to_pylist()]
                    first = [text.find(q) for q in quotes]
                    ends = [k + len(q) for k, q in zip(first, quotes)]
                    found[0].append(first)
                    found[1].append([k >= 0 and text.find(q, k + 1) >= 0 for k, q in zip(first, quotes)])
                    found[2].append([text[max(0, k - context) : k] if k > 0 else "" for k in first])
                    found[3].append([text[e : e + context] if k >= 0 else "" for k, e in zip(first, ends)])
                kept = [c for c in batch.schema.names if c != "_text"]
                kinds = (pa.int32(), pa.bool_(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *(pa.array(x, pa.list_(k)) for x, k in zip(found, kinds))], names=[*kept, "_first", "_again", "_before", "_after"])

    return run


def build_anchors(claims: DataFrame, blocks: DataFrame, keys: list[str], context: int = CONTEXT) -> DataFrame:
    """claims (keys, quote, ...) with the anchor in the block of the same keys: char_start, char_end, prefix, suffix, text_hash (of
    the quote), page_no, bbox and error: blank_quote, not_single_prov, not_found (also without a block), ambiguous (overlapping
    places count) or cuts_a_word. With an error all else is null.

    The claims of a block meet its text as one row, so a text is moved once and not once for each of its claims."""
    of = _placed(blocks).select(*keys, F.col("text").alias("_text"), F.col("n_prov").alias("_n"), F.col("page_no").alias("_page"), F.col("bbox").alias("_bbox"))
    rest = [c for c in claims.columns if c not in keys]
    met = claims.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_claims")).join(of, keys, "left")
    lists = [("_first", T.IntegerType()), ("_again", T.BooleanType()), ("_before", T.StringType()), ("_after", T.StringType())]
    schema = T.StructType([f for f in met.schema if f.name != "_text"] + [T.StructField(c, T.ArrayType(kind)) for c, kind in lists])
    names = ["_claims", *(c for c, _ in lists)]
    rows = met.mapInArrow(_looked_up(max(context, 1)), schema).select(*keys, "_n", "_page", "_bbox", F.explode(F.arrays_zip(*names)).alias("_e"))
    rows = rows.select(*keys, *[F.col(f"_e._claims.`{c}`").alias(c) for c in rest], "_n", "_page", "_bbox", *[F.col(f"_e.{c}").alias(c) for c in names[1:]])
    quote = F.coalesce("quote", F.lit(""))
    error = F.when(python_strip(quote) == "", "blank_quote").when(F.col("_n").isNotNull() & (F.col("_n") != 1), "not_single_prov").when(F.col("_first") < 0, "not_found").when(F.col("_again"), "ambiguous").when(_cuts(quote, F.col("_before"), F.col("_after")), "cuts_a_word")
    rows = rows.withColumn("_error", error)
    fields = {
        "char_start": F.col("_first"), "char_end": (F.col("_first") + F.length(quote)).cast("int"), "prefix": F.col("_before") if context else F.lit(""), "suffix": F.col("_after") if context else F.lit(""),
        "text_hash": F.sha2("quote", 256), "page_no": F.col("_page"), "bbox": F.col("_bbox"),
    }
    anchor = F.struct(*[F.when(F.col("_error").isNull(), v).alias(k) for k, v in fields.items()], F.col("_error").alias("error"))
    return rows.withColumn("anchor", anchor).select(*keys, *rest, "anchor")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _places(text: pd.Series, quote: pd.Series, prefix: pd.Series, suffix: pd.Series) -> pd.Series:
    def of(t: str, q: str, before: str, after: str) -> list[int]:
        return [k for k in find_all(t, q) if aligned(t, k, k + len(q)) and t[:k].endswith(before or "") and t[k + len(q) :].startswith(after or "")]

    return pd.Series([of(*x) for x in zip(text, quote, prefix, suffix)])


def resolve_anchors(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """records (record_id, doc_id, block_id, page_no, quote, char_start, char_end, prefix, suffix, text_hash) against blocks (doc_id,
    block_id, text, and prov or page_no): record_id, level, page_no, block_id, char_start, char_end, bbox, n_matches.

    level: exact (the block still has the quote at its place), relocated (one place in the document where the quote stands whole
    between its old neighbours), ambiguous (several), block (the quote is found in a block of no one place on a page, or the
    block is there and on its page), page (the page is there), unresolved."""
    b = _placed(blocks).select("doc_id", F.col("block_id").alias("b_id"), F.col("text").alias("b_text"), F.col("n_prov").alias("b_n"), F.col("page_no").alias("b_page"), F.col("bbox").alias("b_bbox"))
    r = records.select("record_id", "doc_id", "block_id", "page_no", "quote", "char_start", "char_end", "prefix", "suffix", "text_hash")
    own = r.join(b, (r["doc_id"] == b["doc_id"]) & (r["block_id"] == b["b_id"]), "left").drop(b["doc_id"])
    there = F.sha2(F.expr("substring(b_text, char_start + 1, char_end - char_start)"), 256) == F.col("text_hash")
    own = own.select("record_id", F.coalesce(there, F.lit(False)).alias("same"), *[F.col(c).alias(f"own_{c[2:]}") for c in ("b_id", "b_n", "b_page", "b_bbox")])
    met = r.join(b, (r["doc_id"] == b["doc_id"]) & F.expr("contains(b_text, quote)") & (F.sha2("quote", 256) == F.col("text_hash"))).where("quote <> ''")
    hits = met.select("record_id", "b_id", "b_n", "b_page", "b_bbox", "quote", F.explode(_places("b_text", "quote", "prefix", "suffix")).alias("at"))
    found = hits.groupBy("record_id").agg(F.count("*").alias("n"), F.min_by(F.struct("b_id", "b_n", "b_page", "b_bbox", "at", F.length("quote").alias("len")), F.struct("b_id", "at")).alias("hit"))
    pages = _placed(blocks).where("page_no is not null").select("doc_id", "page_no").distinct() if "prov" not in blocks.columns else blocks.select("doc_id", F.explode("prov").alias("p")).select("doc_id", "p.page_no").distinct()
    pages = pages.withColumn("has_page", F.lit(True))
    rows = r.join(own, "record_id").join(found, "record_id", "left").join(pages, ["doc_id", "page_no"], "left")
    exact = F.col("same") & (F.col("own_n") == 1)
    own_only = F.col("same") & (F.col("own_n") != 1)
    n = F.coalesce("n", F.lit(0))
    moved = ~F.col("same") & (n == 1)
    still = F.col("own_id").isNotNull() & (F.col("own_n") == 1) & (F.col("own_page").eqNullSafe(F.col("page_no")))
    level = (
        F.when(exact, "exact").when(own_only, "block").when(moved & (F.col("hit.b_n") == 1), "relocated").when(moved, "block").when(n > 1, "ambiguous").when(still, "block").when(F.col("has_page"), "page").otherwise("unresolved")
    )
    rows = rows.withColumn("level", level)
    is_ = lambda *v: F.col("level").isin(*v)
    in_own = F.col("same") | (is_("block") & ~moved)
    return rows.select(
        "record_id",
        "level",
        F.when(exact | (~F.col("same") & is_("block") & ~moved), F.col("own_page")).when(is_("relocated"), F.col("hit.b_page")).when(is_("page"), F.col("page_no")).alias("page_no"),
        F.when(in_own, F.col("own_id")).when(moved, F.col("hit.b_id")).alias("block_id"),
        F.when(exact, F.col("char_start")).when(is_("relocated"), F.col("hit.at")).cast("int").alias("char_start"),
        F.when(exact, F.col("char_end")).when(is_("relocated"), F.col("hit.at") + F.col("hit.len")).cast("int").alias("char_end"),
        F.when(exact | (~F.col("same") & is_("block") & ~moved), F.col("own_bbox")).when(is_("relocated"), F.col("hit.b_bbox")).alias("bbox"),
        F.when(F.col("same"), F.lit(1)).otherwise(n).cast("int").alias("n_matches"),
    )


def clean(resolved: DataFrame) -> DataFrame:
    """What may pass without a look: exact or relocated alone."""
    return resolved.where("level in ('exact', 'relocated')")


def public(anchors: DataFrame) -> DataFrame:
    """What may be published of anchors: no text around the quote, and no place within the block."""
    return anchors.withColumn("anchor", F.col("anchor").dropFields("prefix", "suffix", "char_start", "char_end"))
