"""Web addresses as columns.

An address is taken apart once into a struct and later expressions read its fields.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.once import bind, with_once

# Query parameters that only track.
TRACKING_PARAMETERS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")
TRACKING_PREFIX = "utm_"

_ABSOLUTE = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
_PARTS = r"(?i)^(https?):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_AUTHORITY = r"^(?:(.*)@)?([^:@]*)(?::(\d*))?$"
# Lower-case host without port, a path and a query of characters that stay as they are, no fragment.
_STAYS = "A-Za-z0-9_~,;:+=@!*()%&$./-"
_PLAIN = rf"^https?://[a-z0-9.-]+(?:/[{_STAYS}]*)?(?:\?[{_STAYS}]+)?\z"
_TRACKED = rf"(?i)[?&](?:{TRACKING_PREFIX}|(?:{'|'.join(TRACKING_PARAMETERS)})(?:[=&]|\z))"


def _encode(c: Column) -> Column:
    """Percent-encode characters an address may not hold as such."""
    unsafe = r"""[^\x21-\x7e]|["<>`{}]"""

    def one(ch: Column) -> Column:
        coded = F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        return F.when(ch.rlike(unsafe), coded).otherwise(ch)

    return F.when(
        c.rlike(unsafe), F.array_join(F.transform(F.split(c, ""), one), "")
    ).otherwise(c)


def _resolve_dots(path: Column) -> Column:
    """Drop ``.`` and apply ``..`` segments."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(
        path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    ).otherwise(path)


def with_address(df: DataFrame, value: str, out: str, base: str | None = None) -> DataFrame:
    """Add struct ``out`` (url, scheme, host, port, path, query, fragment, folder) or NULL.

    Only http and https without user info count. ``url`` is canonical: lower-case host, no
    fragment, no default port, no tracking parameters, no trailing slash. ``base`` names a
    struct of this kind, against which relative references resolve. Most texts are addresses in
    their canonical form already, which one pattern tells, and are only cut into their parts.
    """
    raw = F.col(value)
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"[\t\n\r]", "")
    df = df.withColumn("__ref", F.when(raw.rlike(r"\s"), bare).otherwise(raw))
    full = F.col("__ref") if base is None else _against(F.col("__ref"), F.col(base))
    df = df.withColumn("__full", full)
    return with_once(df, out, _taken_apart(SparkContext._active_spark_context)).drop("__ref", "__full")


@lru_cache(maxsize=1)
def _taken_apart(context: SparkContext | None) -> Column:
    """The address of column ``__full``; built once for a context, as it takes some thousand calls to the JVM."""
    full = F.col("__full")
    is_plain = full.rlike(_PLAIN) & ~full.contains("/.")
    return F.when(is_plain, _plain_address(_untracked(full))).otherwise(_address(full))


def _untracked(full: Column) -> Column:
    """A text that fits ``_PLAIN`` without the query parameters that only track."""
    asked = F.substring_index(full, "?", 1)
    pairs = F.split(F.substring(full, F.length(asked) + 2, F.length(full)), "&")
    kept = F.array_join(F.filter(pairs, lambda pair: ~_is_tracking(pair)), "&")
    clean = bind(kept, lambda k: F.concat(asked, F.when(k != "", F.concat(F.lit("?"), k)).otherwise("")))
    return F.when(full.contains("?") & full.rlike(_TRACKED), clean).otherwise(full)


def _fields(url, scheme, host, port, path, query, fragment, folder) -> Column:
    return F.struct(
        url.alias("url"), scheme.alias("scheme"), host.alias("host"), port.alias("port"), path.alias("path"),
        query.alias("query"), fragment.alias("fragment"), folder.alias("folder"),
    )


def _plain_address(full: Column) -> Column:
    """The address of a text that fits ``_PLAIN``, cut at its marks."""
    end = lambda c, start: F.substring(c, start, F.length(c))
    none = F.lit("")

    def named(scheme: Column, located: Column, query: Column) -> Column:
        def pathed(host: Column, path: Column) -> Column:
            bare = F.rtrim(path, F.lit("/"))
            shown = F.when(bare == "", "/").otherwise(bare)
            folder = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))
            return _fields(F.concat(scheme, F.lit("://"), host, shown, query), scheme, host, none, shown, query, none, folder)

        host = F.substring_index(located, "/", 1)
        path = F.when(located == host, "/").otherwise(end(located, F.length(host) + 1))
        return bind(F.struct(host.alias("host"), path.alias("path")), lambda x: pathed(x["host"], x["path"]))

    def cut_up(full: Column) -> Column:
        scheme, asked = F.substring_index(full, "://", 1), F.substring_index(full, "?", 1)
        parts = F.struct(scheme.alias("scheme"), end(asked, F.length(scheme) + 4).alias("located"), end(full, F.length(asked) + 1).alias("query"))
        return bind(parts, lambda x: named(x["scheme"], x["located"], x["query"]))

    return bind(full, cut_up)


def _address(full: Column) -> Column:
    """The address of any text, NULL if it is none."""

    def resolved(p: Column) -> Column:
        path = bind(F.when(p["path"] == "", "/").otherwise(_encode(p["path"])), _resolve_dots)
        kept = F.filter(
            F.split(F.substring(p["query"], F.lit(2), F.length(p["query"])), "&"), lambda pair: ~_is_tracking(pair)
        )
        fields = F.struct(
            p["scheme"].alias("scheme"),
            F.lower(F.regexp_extract(p["authority"], _AUTHORITY, 2)).alias("host"),
            F.regexp_extract(p["authority"], _AUTHORITY, 3).alias("port"),
            path.alias("path"),
            _encode(F.array_join(kept, "&")).alias("query"),
            p["fragment"].alias("fragment"),
            p["authority"].contains("@").alias("has_user"),
        )
        return bind(fields, canonical)

    def canonical(s: Column) -> Column:
        default_port = ((s["scheme"] == "https") & (s["port"] == "443")) | ((s["scheme"] == "http") & (s["port"] == "80"))
        port = F.when(default_port, "").otherwise(s["port"])
        bare = F.regexp_replace(s["path"], "/+$", "")
        path = F.when(bare == "", "/").otherwise(bare)
        query = F.when(s["query"] != "", F.concat(F.lit("?"), s["query"])).otherwise("")
        url = F.concat(
            s["scheme"], F.lit("://"), s["host"],
            F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path, query,
        )
        sound = (s["host"] != "") & ~s["host"].rlike(r"""[\s<>"^|%]""") & ~s["has_user"]
        folder = F.regexp_replace(s["path"], "[^/]*$", "")
        return F.when(sound, _fields(url, s["scheme"], s["host"], port, path, query, s["fragment"], folder))

    return bind(_split(full), lambda p: F.when(p.isNotNull(), resolved(p)))


def _split(full: Column) -> Column:
    part = lambda n: F.regexp_extract(full, _PARTS, n)
    return F.when(
        full.rlike(_PARTS),
        F.struct(
            F.lower(part(1)).alias("scheme"),
            part(2).alias("authority"),
            part(3).alias("path"),
            part(4).alias("query"),
            part(5).alias("fragment"),
        ),
    )


def _against(ref: Column, b: Column) -> Column:
    """Absolute form of a reference, given the address it stands on."""
    port = F.when(b["port"] != "", F.concat(F.lit(":"), b["port"])).otherwise("")
    origin = F.concat(b["scheme"], F.lit("://"), b["host"], port)
    return (
        F.when(ref.rlike(_ABSOLUTE), ref)
        .when(ref.startswith("//"), F.concat(b["scheme"], F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(origin, b["path"], ref))
        .when(ref.startswith("#") | (ref == ""), F.concat(origin, b["path"], b["query"], ref))
        .otherwise(F.concat(origin, b["folder"], ref))
    )


def _is_tracking(pair: Column) -> Column:
    name = F.lower(F.regexp_extract(pair, "^([^=]*)", 1))
    return name.startswith(TRACKING_PREFIX) | name.isin(*TRACKING_PARAMETERS)


def query_value(address: Column, name: str) -> Column:
    """Value of a query parameter, NULL if it is absent."""
    pattern = rf"[?&]{name}=([^&]*)"
    bare = rf"[?&]{name}(?:=|&|$)"
    return F.when(
        address["query"].rlike(bare), F.regexp_extract(address["query"], pattern, 1)
    )


def comparable(value: Column) -> Column:
    """Form in which two addresses are compared: http(s), no fragment, no trailing slash."""
    pattern = r"(?i)^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"

    def form(text: Column) -> Column:
        path = F.regexp_replace(F.regexp_extract(text, pattern, 3), "/+$", "")
        return F.when(
            text.rlike(pattern),
            F.concat(
                F.lower(F.regexp_extract(text, pattern, 1)),
                F.lit("://"),
                F.lower(F.regexp_extract(text, pattern, 2)),
                F.when(path == "", "/").otherwise(path),
                F.regexp_extract(text, pattern, 4),
            ),
        )

    return bind(F.regexp_replace(value, r"^\s+|\s+$", ""), form)
