"""Is a page's text fit for extraction? Ordered rules on tokens and characters, then a decision per document; Bates stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.semantics import SPACE, python_strip

#: Frequent words of English and of records; a page of prose holds many of them. A weak sign: which words exactly doesn't matter.
COMMON = tuple(
    sorted(
        set(
            """a able about above accept access according account across act action actions activity add added address after again against age agency agent ago agree agreed agreement
            all allow allowed almost along already also although always am among amount an and animal another answer any anyone anything appear application apply approved are area around
            arrest as ask asked assigned at attached attempt attorney authority available away back bad bank based be became because become been before began begin behind being believe below
            best better between big bill black blue board body book both box boy bring brought building built business but by call called came can cannot car card care carry case cases
            cause center certain change charge chief child children city civil claim class clear close code come committee common community company complaint complete concerning condition
            contact contract control copy cost could council county course court cover crime criminal current cut data date day days deal death december decision defendant department
            describe described detail did different direct direction director district division do document documents does done door down drive driver due during each early earth east
            education effect eight either email emergency employee end enforcement enough entire entry even event events ever every evidence example experience eye face fact family far
            farm father federal feel feet felt female few field file filed final find fire first five follow followed following food for form former found four free friday friend from
            front full fund further future gave general get girl give given go going gone good got government great green ground group grow had hand hands has have having he head health
            hear heard held help her here high him himself his history hold home hour hours house how however human hundred i idea if important in include included including incident
            increase information inside instead interest into investigation involved is issue issued it item its itself january job judge july june just justice keep kind knew know known
            land large last late later law lay lead learn least leave left legal less let letter level license life light like line list little live local location long look looked lot
            low made mail main make male man manager many march matter may me mean means meeting member members men message might mile million mind minute minutes miss money month months
            more morning most mother motion move much must my name named national near necessary need needed never new news next night no north not note nothing notice november now number
            october of off office officer officers official often oh old on once one only open operation or order other others our out outside over own page paid paper part particular
            parties party past pay payment people per perhaps period permit person personal phone photo picture place plan plant play please point police policy position possible power
            present president press probably problem procedure process program project property provide provided public purpose put question quite ran rate rather read ready real reason
            reasons received recent record records red refer regarding regular related release remember report reported reports request required response responsible rest result results
            return review right river road room rule run said same saw say says school search second secretary section security see seem seen self send sent september service services set
            seven several shall she short should show side sign signed since site six small so social some something soon south special staff stand start state statement states station
            still stop story street strong study subject such sun support sure system table take taken talk tell ten term terms than that the their them themselves then there these they
            thing things think third this those though thought three through thursday time times to today together told too took top total toward town travel tree true try tuesday turn
            turned two type under understand unit until up upon us use used using vehicle very view visit voice walk want wanted war was watch water way we wednesday week well went were
            west what when where whether which while white who whole whom whose why will window wish with within without witness woman women word words work worked world would write
            written wrong year years yes yet you young your der die und das ist nicht"""
            .split()
        )
    )
)
FEW_CHARS, FEW_TOKENS, LOW_HIT, MIN_LETTERS, MAX_RUN, LOW_PARSE, SHARE = 12, 4, 0.20, 0.05, 8, 0.05, 0.5
BATES = r"\b[A-Z][A-Z0-9]{1,}[-_ ]?\d{3,}\b"


def tokens(c: Column) -> Column:
    """Runs of ASCII letters, in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1)), F.lower)


def hit_rate(c: Column, words: Sequence[str] = COMMON) -> Column:
    """Share of the tokens that are common words; null without a token, which is no rate of 0."""
    t = tokens(c)
    return F.try_divide(F.size(F.filter(t, lambda x: x.isin(*words))).cast("double"), F.size(t).cast("double"))


def density_ok(c: Column) -> Column:
    """ASCII letters are a share of what is no space, and no run of other characters, unbroken by space, is long."""
    solid = F.length(F.regexp_replace(c, SPACE, ""))
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    runs = F.regexp_extract_all(c, F.lit(f"([^A-Za-z{SPACE[1:-1]}]+)"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return F.coalesce((F.try_divide(letters, solid) >= MIN_LETTERS) & (longest <= MAX_RUN), F.lit(False))


def diagnosis(text: Column, parse_score: Column | None = None, words: Sequence[str] = COMMON) -> Column:
    """image_only, uncertain_review, garbled_text or native_ok: the first rule that holds. Few common words alone garble nothing."""
    t = F.coalesce(text, F.lit(""))
    n = F.size(tokens(t))
    out = F.when((F.length(python_strip(t)) < FEW_CHARS) & (n == 0), "image_only").when(n < FEW_TOKENS, "uncertain_review").when((hit_rate(t, words) < LOW_HIT) & ~density_ok(t), "garbled_text")
    if parse_score is not None:
        out = out.when(F.nanvl(parse_score, F.lit(None).cast("double")) <= LOW_PARSE, "uncertain_review")
    return out.otherwise("native_ok")


def decision(n: Column, uncertain: Column, garbled: Column, image_only: Column) -> Column:
    """What to do with a document of n pages, by the shares of diagnoses: the first rule that holds."""
    share = lambda c: F.try_divide(c.cast("double"), n.cast("double"))
    forced = (share(garbled) >= SHARE) | ((garbled > 0) & (share(image_only + garbled) >= SHARE))
    return F.when(n == 0, "review").when(share(uncertain) >= SHARE, "review").when(forced, "force_full_doc_ocr").when(share(image_only) >= SHARE, "ocr_images").otherwise("native")


def decide(pages: DataFrame, doc: str, diagnosed: str = "diagnosis") -> DataFrame:
    """doc, n_pages, decision."""
    of = lambda v: F.count_if(F.col(diagnosed) == v)
    counts = pages.groupBy(doc).agg(F.count("*").alias("n_pages"), of("uncertain_review").alias("_u"), of("garbled_text").alias("_g"), of("image_only").alias("_i"))
    return counts.select(doc, "n_pages", decision(F.col("n_pages"), F.col("_u"), F.col("_g"), F.col("_i")).alias("decision"))


def bates(pages: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each stamp."""
    return pages.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(f"({BATES})"), F.lit(1))).alias("nth", "stamp"))


def assemble(blocks: DataFrame, doc: str, page: str, position: str, text: str) -> DataFrame:
    """Texts of blocks that aren't blank, joined by line ends in order, one row for each page."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return blocks.where(F.trim(text) != "").groupBy(doc, page).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))
