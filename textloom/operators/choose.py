"""Which filings to fetch: index rows, quotas, what is done already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import padded_cik

DONE = ("ok", "ok_existing", "no_primary_doc", "no_match")
#: HTTP answers worth another try.
RETRY = (429, 500, 502, 503, 504)


def parse_index(lines: DataFrame, forms: list[str] | None = None, line: str = "value") -> DataFrame:
    """(cik, company, form, filed, accession, year) from pipe-separated index lines; other lines fall out."""
    part = F.transform(F.split(line, "\\|"), lambda x: F.trim(x))
    rows = lines.select(part.alias("p")).filter(F.size("p") == 5)
    rows = rows.select(
        padded_cik(F.get("p", 0)).alias("cik"), F.get("p", 1).alias("company"), F.get("p", 2).alias("form"), F.get("p", 3).alias("filed"),
        F.regexp_extract(F.get("p", 4), "(\\d{10}-\\d{2}-\\d{6})\\.txt$", 1).alias("dashed"),
    )
    rows = rows.filter((F.col("dashed") != "") & F.col("filed").rlike("^\\d{4}-\\d{2}-\\d{2}$") & F.col("cik").isNotNull())
    rows = rows.withColumns({"accession": F.replace("dashed", F.lit("-"), F.lit("")), "year": F.substring("filed", 1, 4).try_cast("int")}).drop("dashed")
    return rows.filter(F.col("form").isin(forms)) if forms else rows


def _quotas(rows: DataFrame, forms: list[str] | None, target: int, years: list[int], seed: int) -> dict:
    """The picked (cik, accession, year) by form, forms picked each by itself (None: all rows together), from one pass over the rows.

    An even quota by year, then what is left in the order of years. Years are taken one after another because a cik used in
    one is closed to later ones. A step that takes n after k were picked takes from its year's first k + n <= target ciks, so
    the driver gets `target` rows of each form and year at most.
    """
    form = F.lit("") if forms is None else F.col("form")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("accession")))
    own = rows.filter(F.col("year").isin(years)).select(form.alias("form"), "year", "cik", F.struct(order.alias("h"), "accession").alias("m"))
    if forms is not None:
        own = own.filter(F.col("form").isin(forms))
    first = own.groupBy("form", "year", "cik").agg(F.min("m").alias("m"))
    nth = F.row_number().over(Window.partitionBy("form", "year").orderBy("m.h", "m.accession"))
    begin: dict = {}
    for r in first.withColumn("nth", nth).filter(F.col("nth") <= target).orderBy("nth").collect():
        begin.setdefault((r.form, r.year), []).append((r.cik, r.m.accession, r.year))
    quota = max(1, target // len(years)) if years else 0
    out: dict = {}
    for f in [""] if forms is None else forms:
        picked, used = [], set()
        for year, most in [*((y, quota) for y in years), *((y, target) for y in years)]:
            open_to = [r for r in begin.get((f, year), []) if r[0] not in used][: max(0, min(most, target - len(picked)))]
            picked += open_to
            used |= {r[0] for r in open_to}
        out[f] = picked
    return out


def quota_sample(rows: DataFrame, target: int, years: list[int], seed: int = 42) -> DataFrame:
    """At most one row of each cik and `target` in all: an even quota by year, then what is left in the order of years."""
    return rows.sparkSession.createDataFrame(_quotas(rows, None, target, years, seed)[""], "cik string, accession string, year int")


def form_sample(rows: DataFrame, target: int, forms: list[str], years: list[int], seed: int = 42, limit: int | None = None) -> DataFrame:
    """The target split evenly over forms, each sampled by itself."""
    picked = _quotas(rows, forms, max(1, target // len(forms)), years, seed)
    out = rows.sparkSession.createDataFrame([(*r, f) for f in forms for r in picked[f]], "cik string, accession string, year int, form string")
    return out.limit(limit) if limit else out


def exclude(rows: DataFrame, seeds: DataFrame, key: str = "accession") -> DataFrame:
    return rows.join(seeds.select(key).distinct(), key, "left_anti")


def last_status(manifest: DataFrame, key: str = "accession", order: str = "seq") -> DataFrame:
    """The latest status of each accession of an append-only manifest."""
    return manifest.groupBy(key).agg(F.max_by("status", order).alias("status"))


def to_do(selected: DataFrame, manifest: DataFrame, retry_errors: bool = False, key: str = "accession", order: str = "seq") -> DataFrame:
    """Selected rows without a final status; errors are done too unless retried."""
    final = [*DONE] if retry_errors else [*DONE, "error"]
    done = last_status(manifest, key, order).filter(F.col("status").isin(final))
    return selected.join(done, key, "left_anti")


def match_filings(selected: DataFrame, filings: DataFrame) -> DataFrame:
    """Selected rows with the first filing of the same cik and accession: its document, and a status."""
    first = Window.partitionBy("cik", "accession").orderBy("nth")
    one = filings.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("cik", "accession", "primary_doc", F.lit(True).alias("found"))
    both = selected.join(one, ["cik", "accession"], "left")
    return both.withColumn("status", F.when(F.col("found").isNull(), "no_match").when(F.coalesce("primary_doc", F.lit("")) == "", "no_primary_doc").otherwise("ready")).drop("found")


def since(filings: DataFrame, day: str) -> DataFrame:
    """Filings, newest first, up to the first that is older than day: later ones don't count, whatever their date."""
    order = Window.partitionBy("cik").orderBy("page", "nth").rowsBetween(Window.unboundedPreceding, 0)
    return filings.withColumn("oldest", F.min("filed").over(order)).filter(F.col("oldest") >= F.lit(day)).drop("oldest")


def pad_years(text: str) -> list[int]:
    """'2013-2015' or '2015,2013' as sorted years."""
    if "-" in text:
        low, high = map(int, text.split("-"))
        return list(range(low, high + 1))
    return sorted(int(x) for x in text.split(","))
