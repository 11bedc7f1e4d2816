"""Storing batches, compared with a small model that handles one row after another."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postlake import schemas
from postlake.functions.scans import carry_last, running_count
from postlake.operators import merge
from postlake.operators.lifecycle import close_observations, expire_postings, lifecycle_state
from postlake.operators.normalize import HASHED, content_fingerprint

T0 = dt.datetime(2026, 7, 1)
COLUMNS = [c.split()[0] for c in schemas.JOB.replace("\n", " ").split(",")]
PRIORITY = {"a": 10, "b": 40, "c": 50}
URL = {"a": "https://a.org/jobs/", "b": "https://b.org/jobs/", "c": "https://c.org/jobs/"}


def row(source, item, **kw):
    url = kw.pop("url", URL[source] + item)
    base = dict.fromkeys(COLUMNS)
    base.update(
        id=f"{source}-{item}", title="Postdoc", institution="Inst", country="Norway", city="Oslo", research_area="Physics", language="English",
        source_language="en", original_title="Postdoc", original_description="Text", description="Text", apply_url=url, source_url=url,
        canonical_url=url, posted_at=T0.date(), employment_type="Full", duration="1 year", tags=["x"], is_active=True, is_demo=False,
        created_at=T0, updated_at=T0, origin_type="collected", source_key=source, source_name=source.upper(), source_item_id=item,
        first_seen_at=T0, last_seen_at=T0, last_verified_at=T0, collection_state="active", source_type="html",
    )
    base.update(kw)
    return base


# --- the model: dictionaries, one row at a time ----------------------------------------------


def useful(v, weak=()):
    return bool(str(v if v is not None else "").strip()) and str(v).strip().lower() not in weak


def explicit(j):
    u = j["apply_url"]
    return bool(u) and u.startswith("https://") and "/jobs/" in u and u not in (j["source_url"], j["canonical_url"])


def print_of(j):
    return tuple(tuple(j[c]) if isinstance(j[c], list) else j[c] for c in HASHED)


def merged(old, new):
    if old is None:
        return dict(new)
    keep = old["source_type"] == "html" and new["source_type"] != "html"
    pick = lambda c, weak=(): new[c] if useful(new[c], weak) else (old[c] if old[c] is not None else new[c])
    out = dict(new, id=old["id"], first_seen_at=old["first_seen_at"])
    for c in ("title", "description"):
        out[c] = old[c] if keep else pick(c)
    for c, s in (("original_title", "title"), ("original_description", "description")):
        out[c] = (old[c] or old[s]) if keep else pick(c)
    for c, weak in merge.WEAK.items():
        out[c] = pick(c, weak)
    out["apply_url"] = new["apply_url"] if explicit(new) else old["apply_url"] if explicit(old) else new["apply_url"]
    out["source_type"] = "html" if "html" in (old["source_type"], new["source_type"]) else "rss"
    out["canonical_url"] = new["canonical_url"] or old["canonical_url"]
    out["tags"] = list(dict.fromkeys([*new["tags"], *old["tags"]]))
    return out


class Model:
    def __init__(self):
        self.jobs, self.seen, self.count = {}, {}, dict(inserted=0, updated=0, unchanged=0, duplicates_merged=0)

    def find(self, r):
        js = sorted(self.jobs.values(), key=lambda j: (j["first_seen_at"], j["id"]))
        ref = any(ch.isalpha() for ch in r["source_item_id"]) and any(ch.isdigit() for ch in r["source_item_id"])
        has = lambda j, item: any(k[1] == item and v == j["id"] for k, v in self.seen.items())
        tests = [
            lambda j: (j["source_key"], j["source_item_id"]) == (r["source_key"], r["source_item_id"]),
            lambda j: self.seen.get((r["source_key"], r["source_item_id"])) == j["id"],
            lambda j: (j["source_key"], j["canonical_url"]) == (r["source_key"], r["canonical_url"]),
            lambda j: j["source_url"] == r["source_url"],
            lambda j: explicit(r) and j["apply_url"] == r["apply_url"],
            lambda j: j["canonical_url"] == r["canonical_url"],
            lambda j: (ref and j["institution"] == r["institution"] and has(j, r["source_item_id"]))
            or (r["deadline"] and (j["institution"], j["title"], j["deadline"]) == (r["institution"], r["title"], r["deadline"]))
            or (j["hash"] == print_of(r) and (j["institution"], j["country"]) == (r["institution"], r["country"])),
        ]
        return next((j for t in tests for j in js if t(j)), None)

    def store(self, r):
        old = self.find(r)
        cross = bool(old) and old["source_key"] != r["source_key"]
        better = cross and PRIORITY[r["source_key"]] < PRIORITY[old["source_key"]]
        raw = bool(old) and old["hash"] == print_of(r)
        new = merged(old, r)
        if cross and not better:
            new.update({c: old[c] for c in merge.RANKED})
            new.update({c: old[c] or new[c] for c in merge.RANKED_TEXT})
        self.count["duplicates_merged"] += cross
        if old is None:
            new["hash"] = print_of(new)
            self.jobs[new["id"]] = new
            self.count["inserted"] += 1
        elif (raw and not better) or (not raw and old["hash"] == print_of(new)):
            self.count["unchanged"] += 1
        else:
            new["hash"] = print_of(new)
            if not better:
                new["source_item_id"] = old["source_item_id"]
            self.jobs[old["id"]] = new
            self.count["unchanged" if raw else "updated"] += 1
        self.seen[r["source_key"], r["source_item_id"]] = (old or new)["id"]


def frame(spark, rows, first=0):
    data = [(first + i, *[r[c] for c in COLUMNS]) for i, r in enumerate(rows)]
    return content_fingerprint(spark.createDataFrame(data, "batch_seq long, " + schemas.JOB))


@pytest.fixture(scope="module")
def priorities(spark):
    return spark.createDataFrame(list(PRIORITY.items()), "source_key string, priority long")


def run(spark, priorities, batches):
    jobs, seen = spark.createDataFrame([], schemas.JOB), spark.createDataFrame([], schemas.OBSERVATION)
    total = dict(inserted=0, updated=0, unchanged=0, duplicates_merged=0)
    for batch in batches:
        done = merge.upsert_postings(jobs, seen, frame(spark, batch), priorities)
        jobs, seen = merge.cut(done.jobs), merge.cut(done.observations)
        for k, v in done.counters().first().asDict().items():
            total[k] += v
    return jobs, seen, total


def check(spark, priorities, batches):
    model = Model()
    for r in (r for b in batches for r in b):
        model.store(r)
    jobs, seen, total = run(spark, priorities, batches)
    assert total == model.count
    blank = lambda v: None if v == "" else v
    compared = [*HASHED, "source_key", "source_item_id", "source_url", "source_type", "original_title", "source_language"]
    got = {r.id: {c: blank(r[c]) for c in compared} for r in jobs.collect()}
    assert got == {k: {c: blank(j[c]) for c in compared} for k, j in model.jobs.items()}
    assert {(r.source_key, r.source_item_id): r.job_id for r in seen.collect()} == model.seen
    assert seen.groupBy("job_id").agg(F.count_if("is_primary").alias("n")).where("n <> 1").isEmpty()
    for key in (["id"], ["source_key", "source_item_id"]):
        assert jobs.groupBy(*key).count().where("count > 1").isEmpty()


def test_copies_changes_and_other_sources(spark, priorities):
    apply = "https://apply.org/jobs/77"
    first = [
        row("b", "n1"), row("b", "n1"), row("b", "n1", title="Postdoc two"), row("b", "n1"),
        row("b", "n2", source_type="html", description="Page text"), row("b", "n2", source_type="rss", description="Feed", deadline=dt.date(2026, 9, 1)),
        row("b", "n3", apply_url=apply, title="Shared"),
    ]
    second = [
        row("a", "m3", apply_url=apply, title="Shared", tags=["y"]), row("a", "m3", apply_url=apply, title="Shared", tags=["y"]),
        row("c", "k3", apply_url=apply, title="Other words", city=""), row("b", "n1", institution="See original source", country="Not specified", duration=""),
        row("c", "new1", deadline=dt.date(2026, 9, 9), title="Fresh"), row("c", "new2", deadline=dt.date(2026, 9, 9), title="Fresh"), row("c", "new1", tags=["z"], deadline=dt.date(2026, 9, 9), title="Fresh"),
    ]
    check(spark, priorities, [first, second])


def test_second_run_changes_nothing(spark, priorities):
    batch = [row("a", f"i{n}", title=f"Postdoc {n}") for n in range(5)]
    *_, total = run(spark, priorities, [batch, batch])
    assert total == dict(inserted=5, updated=0, unchanged=5, duplicates_merged=0)


def test_one_posting_fills_the_batch(spark, priorities, monkeypatch):
    monkeypatch.setattr(merge, "CHUNK_ROWS", 8)
    rnd = random.Random(3)
    batch = [row("a", "hot", title=f"Postdoc {rnd.randrange(3)}", tags=[f"t{rnd.randrange(14)}"], duration=rnd.choice(["", "2 years"])) for _ in range(40)]
    check(spark, priorities, [batch])


@pytest.mark.parametrize("seed", [1])
def test_random_batches(spark, priorities, seed):
    rnd = random.Random(seed)

    def some():
        s, n = rnd.choice("abc"), rnd.randrange(4)
        url = URL[s] + str(n)
        return row(
            s, f"{s}{n}", url=url, title=f"Postdoc {n} {rnd.randrange(2)}", institution=rnd.choice([f"Inst {s}{n}", "See original source"]),
            apply_url=f"https://apply.org/jobs/{n}" if n % 2 else url, source_type=rnd.choice(["rss", "html"]),
            tags=[rnd.choice("pqr")], city=rnd.choice(["", "Oslo"]), source_language=rnd.choice(["en", "unknown"]),
        )

    # One source per batch, as sources deliver.
    batches = []
    for s in rnd.sample("abc", 3):
        batches.append([r for r in (some() for _ in range(60)) if r["source_key"] == s])
    check(spark, priorities, batches)


def test_hash_in_python_is_the_column(spark):
    from postlake.operators import fold
    from postlake.operators.normalize import content_hash

    odd = ["", None, "plain", 'q"uo\\te/', "\x00\x01\x1f\x7f\t\n\r\b\f", "é € \u2028 \U0001f600", "<&>'"]
    rows = [row("a", str(n), title=t, description=odd[-n - 1], city=t, tags=tags, deadline=d) for n, t in enumerate(odd) for tags in (None, [], [t, None], ["x", t]) for d in (None, T0.date())]
    data = [tuple(r[c] for c in COLUMNS) for r in rows]
    got = spark.createDataFrame(data, schemas.JOB).withColumn("content_hash", content_hash()).collect()
    for r in got:
        assert fold.content_hash({c: (str(r[c]) if c == "deadline" and r[c] else r[c]) for c in HASHED}) == r.content_hash
        assert fold.content_hash(r.asDict()) == r.content_hash


def test_very_many_versions_of_one_posting(spark):
    from postlake.operators import fold

    columns = [*merge.STATE, "apply_usable", "priority"]
    r = row("a", "hot")
    kinds = ", ".join(f"{c.split()[0]} {c.split()[1]}" for c in schemas.JOB.replace("\n", " ").split(",")) + ", apply_usable boolean, priority long"
    form = spark.createDataFrame([], kinds).select(*columns).schema
    n = 100_000
    one = spark.createDataFrame([tuple({**r, "apply_usable": False, "priority": 10}[c] for c in columns)], form)
    versions = spark.range(1, n + 1).select(F.lit("hot").alias("job_id"), F.col("id").alias("version_no")).crossJoin(one.select(F.struct(*columns).alias("v")))
    versions = versions.withColumn("v", F.col("v").withField("title", F.concat(F.lit("Postdoc "), (F.col("version_no") % 3).cast("string"))))
    empty = spark.createDataFrame([], form).select(F.lit("x").alias("job_id"), F.struct(*columns).alias("row"))
    rules_ = fold.Rules(merge.EDITABLE, merge.WEAK, merge.PAGE_TEXT, merge.RANKED, merge.RANKED_TEXT)
    out = merge.cut(fold.fold_versions(empty, versions, rules_))
    assert {r.action: r["count"] for r in out.groupBy("action").count().collect()} == {"insert": 1, "update": n - 1}
    (last,) = out.where("row IS NOT NULL").collect()
    assert last.version_no == n and last.row.title == f"Postdoc {n % 3}"


def test_scans_match_plain_windows(spark):
    from pyspark.sql import Window

    rnd = random.Random(5)
    data = [(rnd.choice("xyz"), i, rnd.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    w = Window.partitionBy("k").orderBy("i")
    chunk = F.floor(F.col("i") / 7)
    for current, end in ((True, 0), (False, -1)):
        want = df.withColumn("c", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, end)))
        got = carry_last(df, ["k"], ["i"], chunk, {"c": "v"}, include_current=current)
        assert sorted(map(tuple, got.select("k", "i", "c").collect())) == sorted(map(tuple, want.select("k", "i", "c").collect()))
    want = df.withColumn("n", F.count_if(F.col("v").isNotNull()).over(w))
    got = running_count(df, ["k"], ["i"], chunk, F.col("v").isNotNull(), "n")
    assert sorted(map(tuple, got.select("k", "i", "n").collect())) == sorted(map(tuple, want.select("k", "i", "n").collect()))


def test_lifecycle(spark):
    now = dt.datetime(2026, 8, 2, 12)
    seen = lambda *a: dt.datetime(*a)
    rows = [
        row("a", "1", deadline=dt.date(2026, 8, 1)), row("a", "2", last_seen_at=seen(2026, 6, 10, 12)), row("a", "3", last_seen_at=seen(2026, 5, 1, 12)),
        row("a", "4", last_seen_at=seen(2026, 7, 20, 12)), row("a", "5", last_seen_at=None), row("a", "6", last_seen_at=seen(2026, 6, 18, 12)),
    ]
    jobs = frame(spark, rows)
    assert [r.state for r in lifecycle_state(jobs, now).orderBy("id").collect()] == ["expired", "stale", "expired", "active", "active", "stale"]
    got = [(r.collection_state, r.expiry_reason) for r in expire_postings(jobs, now).orderBy("id").collect()]
    assert got == [("expired", "past_deadline"), ("stale", "unseen_45_days"), ("expired", "unseen_75_days"), ("active", None), ("active", None), ("stale", "unseen_45_days")]


def test_closing(spark, priorities):
    batch = [row("a", "1", apply_url="https://x.org/jobs/1"), row("b", "2", apply_url="https://x.org/jobs/1"), row("b", "3")]
    jobs, seen, _ = run(spark, priorities, [batch])
    close = lambda *items: close_observations(seen, jobs, spark.createDataFrame(items, "source_key string, source_item_id string"), T0)[1]
    states = lambda df: {r.id: (r.is_active, r.expiry_reason) for r in df.collect()}
    assert states(close(("b", "2"))) == {"a-1": (True, None), "b-3": (True, None)}
    assert states(close(("a", "1"))) == {"a-1": (False, "primary_source_closed"), "b-3": (True, None)}
    assert states(close(("b", "3"), ("z", "9"))) == {"a-1": (True, None), "b-3": (False, "primary_source_closed")}


def test_a_batch_is_kept_in_little_room(spark, tmp_path):
    """Scratch tables take less than 130 bytes a delivery (360 before, at scale 0.1)."""
    from postlake.plans.queries import load_all

    rows = spark.range(40_000).select(
        F.expr("id DIV 4").alias("l_orderkey"), F.expr("CAST(id % 4 AS INT)").alias("l_linenumber"), F.expr("id % 997").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
        F.lit(1.0).alias("l_quantity"), F.expr("CASE (id * 7) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END").alias("l_returnflag"),
        F.expr("IF((id * 13) % 5 < 2, 'O', 'F')").alias("l_linestatus"),
    )
    rows.repartition(4, F.rand(1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    names = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("*")}
    before = names()
    out = load_all()["fold_batch"].run(spark, str(tmp_path))
    assert (out.count(), out.agg(F.sum("deliveries"), F.sum("inserted")).first()[0:2]) == (10_000, (40_000, 10_000))
    made = [p for n in names() - before for p in (Path(spark.conf.get("spark.checkpoint.dir")) / n).rglob("*.parquet")]
    assert sum(p.stat().st_size for p in made) < 40_000 * 130


def test_chains_over_identities_and_stored_rows(spark, priorities):
    """Rows that follow a repeat of another identity, and repeats whose first row was stored under another key."""
    shared = "https://apply.org/jobs/9"
    first = [row("b", "n1", deadline=dt.date(2026, 9, 9), title="Old")]
    second = [
        row("c", "p1", title="One"), row("c", "p1", title="Two", apply_url=shared), row("c", "p2", title="Other", apply_url=shared),
        row("c", "p2", title="Again"), row("c", "p3", deadline=dt.date(2026, 9, 9), title="Old"), row("c", "p3", title="Since"),
        row("c", "p4", apply_url="https://apply.org/jobs/10"), row("c", "p5", title="P5", apply_url="https://apply.org/jobs/10"), row("c", "p6", title="P5", url=URL["c"] + "p5"),
    ]
    check(spark, priorities, [first, second])
