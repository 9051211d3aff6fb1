"""Bibliographic works: records from JSON and Atom, seed lookup, batched lookup, citing samples by year."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftgraph.functions import scalars
from weftgraph.sources.store import cut, placed

#: The fields of a work that are read.
WORK_SCHEMA = (
    "id string, ids struct<arxiv:string,doi:string>, title string, publication_year int, cited_by_count long, "
    "authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, "
    "referenced_works array<string>, counts_by_year array<struct<year:int,cited_by_count:long>>"
)
ATOM_SCHEMA = "entry array<struct<title:string,summary:string,author:array<struct<name:string>>>>"
#: Bands of a citing sample and how many works each takes.
BANDS = {"recent": 20, "mid": 20, "early": 10}


def record(work: Column) -> list[Column]:
    """A paper record's columns from a parsed work; missing title and count are empty and 0, nameless authors are left out."""
    names = F.transform(work["authorships"], lambda a: a["author"]["display_name"])
    counts = F.transform(work["counts_by_year"], lambda c: F.struct(c["year"].alias("year"), c["cited_by_count"].alias("count")))
    return [
        scalars.node_id(work["ids"]["arxiv"], work["ids"]["doi"], work["id"]).alias("node_id"), scalars.last_segment(work["ids"]["arxiv"]).alias("arxiv_id"),
        work["ids"]["doi"].alias("doi"), scalars.last_segment(work["id"]).alias("source_key"), F.coalesce(work["title"], F.lit("")).alias("title"), work["publication_year"].alias("year"),
        F.coalesce(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>")).alias("authors"), scalars.abstract_text(work["abstract_inverted_index"]).alias("abstract"),
        F.coalesce(work["cited_by_count"], F.lit(0)).alias("citation_count"), F.transform(work["referenced_works"], scalars.last_segment).alias("references"), counts.alias("counts_by_year"),
    ]


def records(raw: DataFrame, column: str = "json") -> DataFrame:
    """Paper records of works given as JSON texts; only the fields read are parsed."""
    return raw.select(F.from_json(column, WORK_SCHEMA).alias("w")).select(*record(F.col("w")))


def atom_abstracts(raw: DataFrame, column: str = "xml") -> DataFrame:
    """title, abstract and authors (joined by commas) of the first entry of each Atom feed; raises, when read, for a feed without one."""
    first = F.get(F.from_xml(F.col(column), ATOM_SCHEMA)["entry"], F.lit(0))
    e = raw.select(F.when(first.isNull(), F.raise_error(F.lit("the feed has no entry")).cast("struct<title:string,summary:string,author:array<struct<name:string>>>")).otherwise(first).alias("e"))
    return e.select(F.trim("e.title").alias("title"), F.trim("e.summary").alias("abstract"), F.array_join(F.transform("e.author", lambda a: a["name"]), ", ").alias("authors"))


def seed_filter(seed: dict) -> str | None:
    """The lookup expression of a seed; only a DOI has one."""
    return f"doi:{seed['doi']}" if seed.get("doi") else None


def refuse_unsupported(seeds: list[dict]) -> None:
    """Raises, before anything runs, if any seed names an arXiv id; every offender is in the message."""
    bad = [f"seed {i} {s!r}" for i, s in enumerate(seeds) if s.get("arxiv_id")]
    if bad:
        raise ValueError(f"arxiv_id seeds are not resolvable, give their DOI: {', '.join(bad)}")


def resolve_seeds(works: DataFrame, seeds: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(resolved works with ``ord``, hop_depth 0 and themselves as root; failures: ord, seed, reason), in the order asked for.

    Raises for no seeds, an unsupported form, and if none is found. Of several works with one DOI the least node_id counts.
    """
    if not seeds:
        raise ValueError("no seeds")
    refuse_unsupported(seeds)
    bare = lambda c: F.lower(F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", ""))
    asked = works.sparkSession.createDataFrame([(i, json.dumps(s, sort_keys=True), s.get("doi") or None) for i, s in enumerate(seeds)], "ord long, seed string, s_doi string")
    hit = asked.join(works, bare(F.col("s_doi")) == bare(F.col("doi")), "left")
    hit = hit.withColumn("place", F.row_number().over(Window.partitionBy("ord").orderBy(F.col("node_id").asc_nulls_last()))).where("place = 1").drop("place")
    failures = hit.where("node_id IS NULL").select("ord", "seed", F.when(F.col("s_doi").isNull(), "unrecognized seed shape").otherwise("no results").alias("reason"))
    resolved = hit.where("node_id IS NOT NULL").withColumn("hop_depth", F.lit(0)).withColumn("root_ids", F.array("node_id")).drop("seed", "s_doi")
    if not resolved.limit(1).count():
        raise ValueError(f"no seed was found: {[(r.seed, r.reason) for r in failures.orderBy('ord').collect()]}")
    return resolved, failures


LOOKED_UP = "json string, failed struct<ids:array<string>,stage:string,reason:string>"


def answers(fetch: Callable[[list[str]], list[str]], batch: list[str], stage: str) -> list[tuple]:
    """The rows of one call: a row for each record, or one for the failure, which costs this batch only."""
    try:
        return [(x, None) for x in fetch(batch)]
    except Exception as e:  # noqa: BLE001  whatever the call raises is the batch's failure
        return [(None, {"ids": batch, "stage": stage, "reason": str(e)})]


def lookup(ids: DataFrame, fetch: Callable[[list[str]], list[str]], stage: str, size: int = 50, calls: Accumulator | None = None) -> DataFrame:
    """Works by id through an injected ``fetch`` of ``size`` ids a call: json, and failed (ids, stage, reason) where a call raised.

    Ids are numbered over the whole table, so all batches but the last are full; batches run in parallel. The result is a written table: records and
    failures can be read apart without calling again. ``calls`` counts the calls (a retried task's again).
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if calls is not None:
            calls.add(1)
        rows = answers(fetch, frame["id"].sort_values().tolist(), stage)
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("json", "failed"))})

    named = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id <> ''").distinct().withColumn("all", F.lit(0))
    batches = placed(named, "all", [F.col("id")]).groupBy(F.expr(f"idx div {size}"))
    return cut(batches.applyInPandas(run, LOOKED_UP))


def works_source(fetch: Callable[[list[str]], list[str]], ids: list[str], stage: str, size: int = 50, calls: Accumulator | None = None) -> type[DataSource]:
    """A data source ``works`` over the injected ``fetch``, to be registered: a partition is a batch of ids, and a read calls once a partition.

    For ids that the caller holds, such as seeds; ``lookup`` takes ids of a table. Rows are those of ``lookup``; ``cut`` what is read more than once.
    """

    class Batch(InputPartition):
        pass

    class Reader(DataSourceReader):
        def partitions(self):
            names = sorted({x for x in ids if x})
            return [Batch(names[i : i + size]) for i in range(0, len(names), size)] or [Batch([])]

        def read(self, partition):
            if not partition.value:
                return
            if calls is not None:
                calls.add(1)
            for text, failed in answers(fetch, partition.value, stage):
                yield (text, failed and (failed["ids"], failed["stage"], failed["reason"]))

    class Works(DataSource):
        @classmethod
        def name(cls):
            return "works"

        def schema(self):
            return LOOKED_UP

        def reader(self, schema):
            return Reader()

    return Works


def search(works: DataFrame, text: str | None = None, key: str | None = None, year: int | None = None, first_author: str | None = None) -> DataFrame:
    """Works by id or DOI, by words in the title, and by year and part of the first author's name."""
    out = works
    if key is not None:
        out = out.where((F.col("source_key") == scalars.last_segment(F.lit(key))) | (F.col("doi") == key))
    for word in (text or "").lower().split():
        out = out.where(F.contains(F.lower("title"), F.lit(word)))
    if year is not None:
        out = out.where(F.col("year") == year)
    return out if first_author is None else out.where(F.contains(F.lower(F.get("authors", F.lit(0))), F.lit(first_author.lower())))


def missing_fields(works: DataFrame, least: int = 5) -> DataFrame:
    """node_id and the names of the required fields that are absent or empty; fewer than ``least`` references count as missing."""
    need = {"id": F.col("source_key"), "doi": F.col("doi"), "title": F.col("title")}
    absent = [F.when(F.coalesce(c, F.lit("")) == "", F.lit(n)) for n, c in need.items()]
    absent += [F.when(F.coalesce("year", F.lit(0)) == 0, F.lit("year")), F.when(F.coalesce(F.size("authors"), F.lit(0)) <= 0, F.lit("authorships")), F.when(F.coalesce(F.size("references"), F.lit(0)) < least, F.lit("referenced_works"))]
    return works.select("node_id", F.array_compact(F.array(*absent)).alias("missing")).where(F.size("missing") > 0)


def year_band(year: Column, current: int, mid: int = 3, early: int = 8) -> Column:
    """Band of a year by its age: recent under ``mid`` years, mid under ``early``, early beyond."""
    age = F.lit(current) - year
    return F.when(age < mid, "recent").when(age < early, "mid").otherwise("early")


def ranked_sample(banded: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """The most cited rows of each seed and band, ties by node_id, as many as ``targets`` has for the band."""
    ranked = banded.withColumn("place", F.row_number().over(Window.partitionBy("seed", "band").orderBy(F.desc("citation_count"), "node_id")))
    most = F.lit(0)
    for band, n in (targets or BANDS).items():
        most = F.when(F.col("band") == band, n).otherwise(most)
    return ranked.where(F.col("place") <= most).drop("place")


def citing_sample(citing: DataFrame, current: int, targets: dict[str, int] | None = None) -> DataFrame:
    """The sample of citing works (seed, year, citation_count, node_id) by bands of years; works without a year are left out."""
    return ranked_sample(citing.where("year IS NOT NULL").withColumn("band", year_band(F.col("year"), current)), targets)


def yearly_points(works: DataFrame) -> DataFrame:
    """node_id, the number of yearly counts (null: none) and whether there are three or more."""
    n = F.size(F.coalesce("counts_by_year", F.array().cast("array<struct<year:int,count:bigint>>")))
    return works.select("node_id", n.alias("counts_by_year_len"), (n >= 3).alias("has_min_3_points"))


def yearly_rate(count: Column, year: Column, current: int) -> Column:
    """Citations a month since the year; null without a count or year, or before a month has passed."""
    months = (F.lit(current) - year) * 12
    return F.when(months > 0, count / months)
