"""Filtered, ordered, paged search over postings; totals and facets."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.text import BLANK, nfkc, strip
from postlake.operators.present import language_code, language_label

_PY_BLANK = re.compile(r"^\s+|\s+$")


def normalize_filters(filters: dict | None) -> dict:
    """Trimmed filters of one search; an unknown deadline option means any.

    A text longer than its limit is refused: cut, it would match more than was asked for.
    """
    filters = dict(filters or {})
    filters.setdefault("keyword", filters.get("q"))
    out = {name: _PY_BLANK.sub("", str(filters.get(name) or "")) for name in rules.FILTER_LIMITS}
    for name, limit in rules.FILTER_LIMITS.items():
        if len(out[name]) > limit:
            raise ValueError(f"{name} is longer than {limit} characters")
    deadline = _PY_BLANK.sub("", str(filters.get("deadline") or "")).lower()
    out["deadline"] = deadline if deadline in rules.DEADLINE_OPTIONS else "any"
    return out


def normalize_filter_rows(requests: DataFrame) -> DataFrame:
    """The same for a table of requests, adding ``filter_key`` and ``meaningful``.

    Texts are brought to one normal form and blank width and kept whole; `validate_requests` is
    what refuses long ones.
    """
    names = list(rules.FILTER_LIMITS)
    have = set(requests.columns)
    raw = {n: (F.col(n) if n in have else F.lit(None)) for n in (*names, "deadline")}
    if "q" in have:
        raw["keyword"] = F.coalesce(raw["keyword"], F.col("q"))

    def clean(c: Column) -> Column:
        return F.trim(F.regexp_replace(nfkc(F.coalesce(c.cast("string"), F.lit(""))), f"{BLANK}+", " "))

    rows = requests.withColumns({n: clean(raw[n]) for n in names})
    option = F.lower(clean(raw["deadline"]))
    option = F.when(option == "no-deadline", "none").otherwise(option)
    rows = rows.withColumn(
        "deadline", F.when(option.isin(*rules.DEADLINE_OPTIONS), option).otherwise("any")
    )
    order = ("keyword", "country", "research_area", "language", "deadline")
    meaningful = F.col("deadline") != "any"
    for n in names:
        meaningful = meaningful | (F.col(n) != "")
    return rows.withColumns(
        {
            "filter_key": F.to_json(F.struct(*[F.lower(n).alias(n) for n in order])),
            "meaningful": meaningful,
        }
    )


def live(as_of: dt.date) -> Column:
    """Active, collected, not demo, not past its deadline."""
    return (
        F.col("is_active")
        & (F.col("origin_type") == "collected")
        & ~F.col("is_demo")
        & (F.col("collection_state") == "active")
        & not_past(as_of)
    )


def not_past(as_of: dt.date) -> Column:
    return F.col("deadline").isNull() | (F.col("deadline") >= F.lit(as_of))


def public_dataset(jobs: DataFrame, as_of: dt.date) -> DataFrame:
    """Collected postings if any of them is live, else the demonstration ones.

    The test is an uncorrelated EXISTS, which Spark runs once and stops at the first hit.
    """
    any_live = jobs.where(live(as_of)).select(F.lit(1)).exists()
    real = (F.col("origin_type") == "collected") & ~F.col("is_demo")
    demo = (F.col("origin_type") == "seed") & F.col("is_demo")
    return jobs.where(
        (F.col("collection_state") == "active") & F.when(any_live, real).otherwise(demo)
    )


def _joined_text(sep: str) -> Column:
    parts = [F.col(c) for c in rules.SEARCHED_COLUMNS if c not in ("language", "tags")]
    parts.append(F.array_join("tags", sep))
    return F.concat_ws(sep, *[F.lower(strip(F.coalesce(p, F.lit("")))) for p in parts])


def filter_predicate(filters: dict, as_of: dt.date, mode: str = "api") -> Column:
    """Predicate of one search.

    ``api`` looks for the keyword in each column, in the raw tag list, and for the language
    anywhere in its column; ``memory`` looks across the joined columns and compares the language.
    """
    f = normalize_filters(filters)
    day = F.lit(as_of)
    cond = not_past(as_of)
    if keyword := f["keyword"].lower():
        if mode == "api":
            hit = F.lit(False)
            for c in rules.SEARCHED_COLUMNS:
                text = F.to_json(c) if c == "tags" else F.col(c)
                hit = hit | F.lower(F.coalesce(text, F.lit(""))).contains(keyword)
        else:
            hit = _joined_text(" ").contains(keyword)
        cond = cond & hit
    if f["country"]:
        cond = cond & (F.lower(strip(F.col("country"))) == f["country"].lower())
    if f["research_area"]:
        cond = cond & (F.lower(strip(F.col("research_area"))) == f["research_area"].lower())
    if language := f["language"].lower():
        text = F.lower(strip(F.col("language")))
        cond = cond & (text.contains(language) if mode == "api" else text == language)
    if f["deadline"] in ("7", "30", "60"):
        cond = cond & F.col("deadline").between(day, F.date_add(day, int(f["deadline"])))
    elif f["deadline"] == "open":
        cond = cond & F.col("deadline").isNotNull()
    elif f["deadline"] == "none":
        cond = cond & F.col("deadline").isNull()
    return cond


def search_filter(jobs: DataFrame, filters: dict, as_of: dt.date, mode: str = "api") -> DataFrame:
    """Matching rows; over the public dataset and active rows only in ``api`` mode."""
    if mode == "memory":
        return jobs.where(filter_predicate(filters, as_of, mode))
    return public_dataset(jobs, as_of).where(F.col("is_active") & filter_predicate(filters, as_of))


def source_language_filter(jobs: DataFrame, expected: str) -> DataFrame:
    """Postings whose source language is the one given by code or name; blank keeps all."""
    if not expected:
        return jobs
    return jobs.where(language_code(F.col("source_language")) == language_code(F.lit(expected)))


def live_only(jobs: DataFrame) -> DataFrame:
    """Real postings only."""
    return jobs.where(~F.coalesce("is_demo", F.lit(False)))


def newest_first() -> list[Column]:
    return [F.desc("posted_at"), F.desc("created_at"), F.desc("id")]


def checked_range(limit: int, offset: int) -> tuple[int, int]:
    """The limit and offset of a page; values out of range are refused, not moved."""
    if not 1 <= limit <= rules.PAGE_LIMIT_MAX:
        raise ValueError(f"limit must be from 1 to {rules.PAGE_LIMIT_MAX}")
    if not 0 <= offset <= rules.OFFSET_MAX:
        raise ValueError(f"offset must be from 0 to {rules.OFFSET_MAX}; go on with search_after beyond")
    return limit, offset


def search_page(
    jobs: DataFrame, filters: dict, as_of: dt.date, limit: int = rules.PAGE_LIMIT, offset: int = 0
) -> DataFrame:
    """One page, newest first, in a total order.

    Bounds on limit and offset keep this a top-k: each task keeps at most offset + limit rows.
    """
    limit, offset = checked_range(limit, offset)
    return search_filter(jobs, filters, as_of).orderBy(*newest_first()).offset(offset).limit(limit)


#: Columns that a stored table keeps in the form in which searches compare them.
KEYED = {"country": "country_key", "research_area": "research_area_key", "language": "language_key"}


def with_search_keys(jobs: DataFrame) -> DataFrame:
    """Add the compared form of filtered columns, so that filters on them reach the files' statistics."""
    return jobs.withColumns({k: F.lower(strip(F.col(c))) for c, k in KEYED.items()})


def write_search_table(jobs: DataFrame, path: str) -> None:
    """Postings with their search keys, in ranges of the order in which pages show them."""
    order = [F.desc("posted_at"), F.desc("created_at"), F.desc("id")]
    with_search_keys(jobs).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def _behind(column: str, value, rest: Column) -> Column:
    """Rows that a descending order with NULLs last puts behind ``value``, or that equal it and are in ``rest``."""
    c = F.col(column)
    if value is None:
        return c.isNull() & rest
    return (c < F.lit(value)) | c.isNull() | ((c == F.lit(value)) & rest)


def search_after(
    table: DataFrame, filters: dict, as_of: dt.date, after: tuple | None = None, limit: int = rules.PAGE_LIMIT
) -> DataFrame:
    """The page that follows the row ``after`` (posted_at, created_at, id) of a table with search keys.

    A page costs the same wherever it is: nothing before it is counted or sorted, each task keeps
    ``limit`` rows, and the cursor's day and the compared keys are plain comparisons on stored columns,
    which skip files and row groups.
    """
    limit, _ = checked_range(limit, 0)
    wanted = normalize_filters(filters)
    rows = search_filter(table, {k: v for k, v in wanted.items() if k not in ("country", "research_area")}, as_of)
    for c in ("country", "research_area"):
        if wanted[c]:
            rows = rows.where(F.col(KEYED[c]) == wanted[c].lower())
    if after is not None:
        posted, created, last = after
        if posted is not None:
            rows = rows.where((F.col("posted_at") <= F.lit(posted)) | F.col("posted_at").isNull())
        rows = rows.where(_behind("posted_at", posted, _behind("created_at", created, _behind("id", last, F.lit(False)))))
    return rows.orderBy(*newest_first()).limit(limit).drop(*KEYED.values())


def search_total(
    jobs: DataFrame, filters: dict, as_of: dt.date, limit: int = rules.PAGE_LIMIT, offset: int = 0
) -> DataFrame:
    """One row: matches in all, rows on this page, whether more follow; the same range as the page."""
    limit, offset = checked_range(limit, offset)
    total = F.count("*")
    shown = F.greatest(F.least(total - offset, F.lit(limit)), F.lit(0))
    return search_filter(jobs, filters, as_of).agg(
        total.alias("total"),
        shown.cast("long").alias("shown"),
        ((F.lit(offset) + shown) < total).alias("has_more"),
    )


def search_many(jobs: DataFrame, requests: dict[str, dict], as_of: dt.date) -> DataFrame:
    """Match counts of several searches in one scan: ``request_id, matching_jobs``.

    The searches are parameters, so each becomes one conditional count over the same pass;
    no request is joined to the postings.
    """
    base = public_dataset(jobs, as_of).where(F.col("is_active"))
    names = list(requests)
    counts = base.agg(
        *[
            F.count_if(F.coalesce(filter_predicate(requests[n], as_of), F.lit(False))).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("request_id"), F.col(f"c{i}").alias("matching_jobs")) for i, n in enumerate(names)]
    )
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def facet_values(jobs: DataFrame, fields: tuple[str, ...] = ("country", "research_area", "language")) -> DataFrame:
    """Distinct non-blank values of each facet with their counts, in reading order."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return (
        jobs.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
        .groupBy("field", "value")
        .agg(F.count("*").alias("n"))
        .orderBy("field", F.collate("value", "UNICODE"))
    )


def source_language_facets(jobs: DataFrame) -> DataFrame:
    return (
        jobs.groupBy(language_code(F.col("source_language")).alias("value"))
        .agg(F.count("*").alias("n"))
        .withColumn("label", language_label(F.col("value")))
        .orderBy(F.collate("label", "UNICODE"))
    )


def merge_pages(rows: DataFrame) -> DataFrame:
    """Rows of pages 1..n, ``(page_no, pos, id, ...)``, to one list without repeats.

    A repeated id keeps its first place and takes its last values; rows without id go.
    """
    values = [c for c in rows.columns if c not in ("page_no", "pos", "id")]
    at = F.struct("page_no", "pos")
    return (
        rows.where(F.coalesce("id", F.lit("")) != "")
        .groupBy("id")
        .agg(F.min(at).alias("first"), F.max_by(F.struct(*values), at).alias("last"))
        .select("id", F.col("first.page_no").alias("page_no"), F.col("first.pos").alias("pos"), "last.*")
    )
