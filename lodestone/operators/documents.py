"""Leads that a PDF's redactions may not hold, flags of converted pages, and an archive of evidence.

Reading a PDF's structure takes a library that is the caller's; checks that can't run make a document not safe to publish."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.evidence import append

SEVERITIES = {"incremental_save": "medium", "metadata": "low", "unapplied_redact": "high", "embedded_files": "medium", "acroform_values": "high", "annotation_text": "medium", "box_over_text": "high", "text_layer": "medium"}
IMAGE_SHARE, IMAGE_CHARS = 0.5, 20
_FINDING = "array<struct<check:string,severity:string,public:string,local:string>>"

#: bytes of a PDF to its findings (public and local parts), or an exception where the check can't be made.
Check = Callable[[bytes], list[tuple[str, str | None]]]


def incremental_save(data: bytes) -> list[tuple[str, str | None]]:
    """More than one end of file: an earlier state may still be in it."""
    n = data.count(b"%%EOF")
    return [(f"{n} ends of file, {data.count(b'startxref')} startxref", None)] if n > 1 else []


def text_layer(pages: DataFrame) -> DataFrame:
    """Pages of an image that still carry text. pages: n_chars, image_share, is_signal."""
    return pages.where((F.col("n_chars") > 0) & (F.coalesce("is_signal", F.lit(False)) | ((F.col("image_share") >= IMAGE_SHARE) & (F.col("n_chars") >= IMAGE_CHARS))))


def check_redactions(files: DataFrame, checks: Mapping[str, Check] | None = None) -> DataFrame:
    """path, findings, unavailable, safe_to_publish. files: path, content. A check that is missing or fails is unavailable, and
    then nothing is called safe; nor is anything with a finding."""
    known = {"incremental_save": incremental_save} | dict(checks or {})

    def run(data: bytes | None) -> tuple[list[tuple[str, str, str, str | None]], list[str]]:
        found, gone = [], [c for c in SEVERITIES if c not in known]
        for name, check in known.items():
            try:
                found += [(name, SEVERITIES.get(name, "medium"), public, local) for public, local in check(bytes(data or b""))]
            except Exception:  # noqa: BLE001  whatever a check dies of, it has not cleared the file
                gone.append(name)
        return found, gone

    out = files.withColumn("_r", F.udf(run, f"struct<findings:{_FINDING},unavailable:array<string>>")("content"))
    return out.select("path", "_r.findings", "_r.unavailable", ((F.size("_r.findings") == 0) & (F.size("_r.unavailable") == 0)).alias("safe_to_publish"))


def publishable(report: DataFrame) -> DataFrame:
    """The report without local evidence; a public text that holds some of it raises."""
    leaks = F.exists("findings", lambda f: f["local"].isNotNull() & (F.length(f["local"]) > 0) & F.contains(f["public"], f["local"]))
    safe = F.when(leaks, F.raise_error(F.lit("a public finding holds local evidence")).cast(_FINDING)).otherwise(F.col("findings"))
    return report.withColumn("findings", F.transform(safe, lambda f: f.dropFields("local")))


#: OCR scores below this are no ground to trust a page.
DEGRADED = 0.85


def flag_reason(diagnosis: Column, ocr_applied: Column, ocr_score: Column, review: Column | None = None, partial: Column | None = None, unavailable: Column | None = None) -> Column:
    """Why a converted page needs eyes: the first reason that holds, else null.

    review: its document is not to be trusted; partial: its conversion ended early; unavailable: preparation for OCR was asked
    for and couldn't run. A page that OCR read is judged by its score, if that is a number; other pages' scores don't count."""
    sure = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    read = sure(ocr_applied)
    low = read & sure(~F.isnan(ocr_score) & (ocr_score < DEGRADED))
    return (
        F.when(sure(review), "review: document not trustworthy for unattended extraction")
        .when(sure(partial), "partial conversion")
        .when(diagnosis == "garbled_text", "garbled text layer")
        .when(diagnosis == "uncertain_review", "uncertain: too little signal to trust the text layer")
        .when((diagnosis == "image_only") & ~read, "image-only page not OCR'd")
        .when(low, F.format_string("low OCR confidence (%.2f)", ocr_score))
        .when(sure(unavailable), "preprocessing requested but unavailable")
    )


def trustworthy(pages: DataFrame, doc: str, reason: str = "flag_reason") -> DataFrame:
    """doc, n_flagged, trustworthy: no page has a reason, and there is a page."""
    return pages.groupBy(doc).agg(F.count(reason).alias("n_flagged"), ((F.count(reason) == 0) & (F.count("*") > 0)).alias("trustworthy"))


def bottom_left(box: Column, page_height: Column) -> Column:
    """A box {l, t, r, b, coord_origin} measured from the bottom left corner."""
    top = F.upper(box["coord_origin"]) == "TOPLEFT"
    flip = lambda v: F.when(top, page_height - v).otherwise(v)
    return F.struct(box["l"].alias("l"), flip(box["t"]).alias("t"), box["r"].alias("r"), flip(box["b"]).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))


def archive(files: DataFrame, known: DataFrame, log: list[dict[str, Any]], *, now: str, actor: str, received: str | None = None) -> tuple[DataFrame, list[dict[str, Any]]]:
    """Manifest rows of files that aren't archived yet (by digest), and the custody log with an entry for each, in the order of the
    digests. files: path, sha256, modified; known: sha256. A file that changed after it was received is marked."""
    new = files.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")
    late = F.col("modified") > F.lit(received).cast("timestamp") if received else F.lit(False)
    manifest = new.select("path", "sha256", "modified", late.alias("modified_after_receipt"), F.lit(now).alias("archived_at"), F.lit(actor).alias("actor"))
    log = list(log)
    for r in manifest.select("sha256").orderBy("sha256").toLocalIterator():  # a chain has one order and grows by one
        append(log, "archived", now=now, artifact_sha256=r["sha256"], actor=actor)
    return manifest, log
