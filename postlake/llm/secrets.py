"""Secret scans: a trigram inverted index picks the texts that each rule's pattern is tried on.

From every rule's pattern a Boolean query over trigrams is derived (`trigram_query`): what must stand
in any text that the pattern matches. The index holds (trigram, text key) postings for the trigrams
that some rule asks for; a rule's candidates are the keys whose postings satisfy its query, and only
there the pattern itself is run. A rule without mandatory trigrams is run on every text. The index
folds case and is keyed by a 64-bit hash of the text, so it may name a text too many but never one
too few.

Cases: a NULL text is an empty one; an empty text has no spans and the digest of the empty string;
a NULL doc_id is carried along; repeated rows each get their own row; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import re._parser as regex_tree
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.once import bind, with_once
from postlake.llm.common import bounded, whole


@dataclass(frozen=True)
class Rule:
    """``group`` is the part of the match whose length must reach ``least``.

    ``guard`` is a cheaper pattern that stands in every text with a match to keep.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    either_case: bool = False
    guard: str | None = None

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.either_case else self.pattern


BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        either_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24, guard=r"[0-9a-f]{24}"),
)
RULES = (
    *BASE_RULES,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("code_host", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", least=40),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("payment", r"(sk|rk)_live_[A-Za-z0-9]+", least=20),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\x00-\x20@/:]+@[A-Za-z0-9.-]+"),
)

#: Alternatives that a run of literals may have before it is closed.
_ALTERNATIVES = 32
#: Spans whose places are summed up together.
_BLOCK = 512


def _joined(kind: str, parts: list):
    """The conjunction or disjunction of queries; True is the query that tells nothing."""
    if kind == "and":
        parts = [p for p in parts if p is not True]
    elif any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]):
    return _joined("or", [_joined("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _analysed(items) -> tuple[set[str] | None, object]:
    """The strings that a parsed sequence can be, if few, and else a query that any match satisfies."""
    runs, query, closed = {""}, [], False

    def close() -> None:
        nonlocal runs, closed
        query.append(_of_strings(runs))
        runs, closed = {""}, True

    for op, value in items:
        name, strings, inner = str(op), None, True
        if name == "LITERAL":
            strings = {chr(value).lower()}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            strings = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            strings, inner = _analysed(value[-1])
        elif name == "BRANCH":
            each = [_analysed(x) for x in value[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*[s for s, _ in each])
            else:
                inner = _joined("or", [q if s is None else _of_strings(s) for s, q in each])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            some, inside = _analysed(body)
            if some is not None and (low, high) == (0, 1):
                strings = some | {""}
            elif some is not None and low == high == 1:
                strings = some
            elif low > 0:
                inner = inside if some is None else _of_strings(some)
        elif name == "AT":
            strings = {""}
        if strings is not None and len(runs) * len(strings) <= _ALTERNATIVES:
            runs = {a + b for a in runs for b in strings}
            continue
        close()
        query.append(inner if strings is None else _of_strings(strings))
    if not closed and len(runs) <= _ALTERNATIVES:
        return runs, _of_strings(runs)
    close()
    return None, _joined("and", query)


def trigram_query(pattern: str):
    """What must stand in a lower-cased text that ``pattern`` matches.

    A trigram, ("and", queries), ("or", queries), or True where the pattern demands no trigram.
    """
    re.compile(pattern)
    return _analysed(regex_tree.parse(pattern))[1]


def grams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[grams_of(q) for q in query[1]])


def _holds(query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    parts = [_holds(q, present) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def trigram_postings(texts: DataFrame, grams: set[str]) -> DataFrame:
    """The inverted index of (key, text) rows, held to ``grams``: one (gram, key) row for each text."""
    asked = F.array(*[F.lit(g) for g in sorted(grams)])
    folded = texts.select("key", F.lower("text").alias("folded"))
    return folded.select("key", F.explode(F.filter(asked, lambda g: F.contains("folded", g))).alias("gram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(key, rules): for each key the rules whose query its postings satisfy, if any."""
    present = postings.groupBy("key").agg(F.collect_set("gram").alias("grams"))  # no more than the rules have
    rules = F.array_compact(F.array(*[F.when(_holds(q, F.col("grams")), F.lit(k)) for k, q in queries.items()]))
    return present.select("key", rules.alias("rules")).where(F.size("rules") > 0)


def _places(parts: Column) -> Column:
    """Start and end of the match in each (gap, found, value) part of a text cut at its matches."""
    width = lambda p: F.length(p["gap"]) + F.length(p["found"])
    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int"))
    block = lambda b: F.slice(parts, b * _BLOCK + 1, _BLOCK)
    heads = F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda n, p: n + width(p))),
        F.array(F.lit(0)),
        lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(s, p):
        at = s["at"] + F.length(p["gap"])
        end = s["at"] + width(p)
        one = F.array(F.struct(at.alias("start"), end.alias("end"), p["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(F.coalesce(s["out"], F.array().cast("array<struct<start:int,end:int,value:string>>")), one).alias("out"))

    each = F.transform(
        F.arrays_zip(blocks.alias("b"), F.slice(heads, F.lit(1), F.size(blocks)).alias("head")),
        lambda x: F.aggregate(
            block(x["b"]),
            F.struct(x["head"].alias("at"), start["out"].alias("out")),
            step,
            lambda s: s["out"],
        ),
    )
    return F.flatten(each)


def rule_table(rules: tuple[Rule, ...]) -> Column:
    """The rules as an array; ``cutter`` cuts a text into (gap, match) parts, the last without a match."""
    return F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(n).alias("place"),
                F.lit(f"(?s)(.*?)(?:({r.java})|\\z)").alias("cutter"),
                F.lit(2 + r.group).alias("group"),
                F.lit(r.least).alias("least"),
            )
            for n, r in enumerate(rules)
        ]
    )


def spans_of(rule: Column, text: Column) -> Column:
    """Leftmost matches of a rule that do not overlap, those with too short a value dropped.

    The text is cut into (gap, match) parts; their lengths give the places.
    """
    pick = lambda g: F.regexp_extract_all(text, rule["cutter"], g)
    parts = F.arrays_zip(pick(F.lit(1)).alias("gap"), pick(F.lit(2)).alias("found"), pick(rule["group"]).alias("value"))
    found = F.filter(bind(parts, _places), lambda p: (F.length(p["value"]) >= rule["least"]) & (p["end"] > p["start"]))
    return F.transform(
        found, lambda p: F.struct(p["start"].alias("start"), rule["place"].alias("place"), p["end"].alias("end"), rule["kind"].alias("kind"))
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): for every row the places of all rules, by start and then by the rules' order.

    The candidate list is broadcast only if it was counted to be small; else it is joined by key.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    base = docs.select("doc_id", whole("text").alias("text")).withColumn("key", F.xxhash64("text"))
    if indexed:
        grams = set().union(*[grams_of(q) for q in indexed.values()])
        wanted = bounded(candidates(trigram_postings(base.select("key", "text"), grams), indexed))
        base = base.join(wanted, "key", "left")
    else:
        base = base.withColumn("rules", F.lit(None).cast("array<string>"))
    scanned = [F.when(F.col("text").rlike(r.guard or r.java), F.lit(r.kind)) for r in rules if r.kind not in indexed]
    none = F.array().cast("array<string>")
    tried = F.concat(F.coalesce("rules", none), F.array_compact(F.array(*scanned)) if scanned else none)
    base = with_once(base, "tried", tried)
    spans = F.transform(
        F.filter(rule_table(rules), lambda r: F.array_contains("tried", r["kind"])), lambda r: spans_of(r, F.col("text"))
    )
    found = with_once(base, "spans", F.array_sort(F.flatten(spans)))
    return found.select("doc_id", "spans")


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `find_secrets`."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    return found.select(
        "doc_id",
        *[count(r.kind) for r in BASE_RULES],
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )
