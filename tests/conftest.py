import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


P1_SCHEMA = "volume_id int, seq long, page int, headword string, dialects array<string>, place string, taxa array<string>, printed_page string, confidence int, raw string, flags array<string>, box array<double>, corrected boolean, ocr_headword string, recorded_at timestamp, withdrawn_at timestamp, loaded_at timestamp"
P2_SCHEMA = "volume_id int, seq long, page int, name string, authority string, family string, notes string, vernaculars array<struct<name:string,dialects:array<string>,place:string>>, genus string, printed_page string, confidence int, recorded_at timestamp, withdrawn_at timestamp, loaded_at timestamp"
FIX_SCHEMA = "correction_id long, volume_id int, page int, was string, occurrence int, taxa array<string>, is_drop boolean, was_taxa array<string>, source string, recorded_at timestamp, loaded_at timestamp"


def at(day: int) -> datetime:
    return datetime(2022, 1, day, tzinfo=timezone.utc)


def table(spark, schema: str, rows: list[dict]):
    """A table of the schema from partial rows; what a row leaves out is null."""
    names = [f.strip().split(" ")[0] for f in _split(schema)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def _split(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


@pytest.fixture(scope="session")
def part1(spark):
    return lambda *rows: table(spark, P1_SCHEMA, [{"volume_id": 1, "page": 5, "loaded_at": at(9), "recorded_at": at(5)} | r for r in rows])


@pytest.fixture(scope="session")
def part2(spark):
    return lambda *rows: table(spark, P2_SCHEMA, [{"volume_id": 1, "page": 50, "loaded_at": at(9), "recorded_at": at(2)} | r for r in rows])


@pytest.fixture(scope="session")
def fixes(spark):
    return lambda *rows: table(spark, FIX_SCHEMA, [{"volume_id": 1, "page": 5, "loaded_at": at(9), "recorded_at": at(6)} | r for r in rows])


@pytest.fixture
def size_broadcasts(monkeypatch):
    """Plans of a result, with those of the tables written for it: the keys and kinds of joins that broadcast a side by its taken size.

    Lists of repeated deliveries and the values of pages (one row a page) may do that.
    """
    import re

    from vernalex.plans import lineage

    cut, small = lineage.cut, lineage.small

    def listed(make, *modules) -> set[str]:
        plans = []

        def spy(df, *by):
            plans.append(df)
            return cut(df, *by)

        for m in (lineage, *modules):
            monkeypatch.setattr(m, "cut", spy)
            if hasattr(m, "small"):
                monkeypatch.setattr(m, "small", lambda df: small(df, -1))
        plans.append(make())
        shown = "\n".join(df._jdf.queryExecution().executedPlan().toString() for df in plans)
        joins = {re.sub(r"#\d+L?", "", j) for j in re.findall(r"Broadcast(?:Hash|NestedLoop)Join (.*?), Build", shown)}
        return joins - {f"[{k}], [{k}], {kind}" for k in ("seq", "correction_id") for kind in ("LeftAnti", "LeftSemi")} - {"[volume_id, page], [volume_id, page], LeftOuter"}

    return listed
