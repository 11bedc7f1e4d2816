"""Address jobs: canonical links, approval, robots rules, page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake import rules
from postlake.functions.text import html_text
from postlake.functions.urls import with_address
from postlake.session import cut
from postlake.sources.listings import _bare, approved, detail_allowed, listing_allowed, with_source


def page_text(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Add the visible ``text`` of ``html``."""
    return pages.withColumn("text", html_text(F.col("html"), limit))


def text_share(texts: DataFrame, *keys: str) -> DataFrame:
    """Characters in, characters kept and their ratio per group."""
    return texts.groupBy(*keys).agg(
        F.count("*").alias("pages"),
        F.sum(F.length("html").cast("long")).alias("chars_in"),
        F.sum(F.length("text").cast("long")).alias("chars_kept"),
    ).withColumn("kept_share", F.col("chars_kept") / F.col("chars_in"))


def canonical_links(links: DataFrame, value: str = "url", base: str | None = None) -> DataFrame:
    """Add ``canonical_url`` and ``host``; NULL for what is no plain web address."""
    rows = links if base is None else with_address(links, base, "__base")
    rows = with_address(rows, value, "__link", base=None if base is None else "__base")
    return rows.withColumns(
        {"canonical_url": F.col("__link.url"), "host": F.col("__link.host")}
    ).drop("__base", "__link")


def same_address_groups(canonical: DataFrame, value: str = "url") -> DataFrame:
    """Canonical addresses under which several written forms fall together."""
    return (
        canonical.where(F.col("canonical_url").isNotNull())
        .groupBy("canonical_url", value)
        .agg(F.count("*").alias("n"))
        .groupBy("canonical_url")
        .agg(F.count("*").alias("forms"), F.sum("n").alias("links"), F.min(value).alias("first_form"))
        .where(F.col("forms") > 1)
    )


def approved_links(links: DataFrame, sources: DataFrame, value: str = "url", hosts: DataFrame | None = None) -> DataFrame:
    """Add ``kind`` (detail, listing or NULL) and ``reject_reason`` under the link's source.

    ``hosts(source_key, host)`` names the hosts of sources that have any number of them, in place of
    the column ``hosts`` of ``sources``.
    """
    rows = with_source(with_address(links, value, "link"), sources)
    link, source = F.col("link"), F.col("source")
    if hosts is not None:
        known = hosts.select(F.col("source_key").alias("__key"), F.col("host").alias("__host")).distinct()
        same = (F.col("source_key") == F.col("__key")) & (link["host"] == F.col("__host"))
        own = F.when(F.col("__host").isNotNull(), F.array("__host")).otherwise(F.array().cast("array<string>"))
        rows = rows.join(known, same, "left").withColumn("source", source.withField("hosts", own)).drop("__key", "__host")
    kind = F.when(listing_allowed(link, source), "listing").when(detail_allowed(link, source), "detail")
    reason = (
        F.when(link.isNull(), "not a web address")
        .when(link["scheme"] != "https", "not secure")
        .when(~approved(link, source["hosts"]), "host not approved")
        .when(kind.isNotNull(), None)
        .when(link["path"].rlike(rules.ASSET_PATH), "asset")
        .when(_bare(link["path"]) == _bare(source["listing_path"]), "listing parameters")
        .otherwise("path not approved")
    )
    return rows.withColumns(
        {"canonical_url": link["url"], "kind": kind, "reject_reason": reason}
    ).drop("link", "source")


# --- robots ---------------------------------------------------------------------------------

_DIRECTIVES = ("user-agent", "allow", "disallow", "crawl-delay")


def robots_lines(files: DataFrame) -> DataFrame:
    """``files(host, text)`` to their directives: ``host, pos, directive, value, group_no``.

    A group starts at an agent that follows something else than an agent; what stands before the first
    group, and directives that say nothing about access, go.
    """
    lines = F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r?\n")
    rows = files.select("host", F.posexplode(lines).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", r"\s+#.*$", ""))
    rows = rows.select("host", "pos", line.alias("line")).where(F.col("line").contains(":"))
    rows = rows.select(
        "host", "pos",
        F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("directive"),
        F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"),
    ).where(F.col("directive").isin(*_DIRECTIVES))
    order = Window.partitionBy("host").orderBy("pos")
    agent = F.col("directive") == "user-agent"
    rows = rows.withColumn("starts", agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False)))
    numbered = rows.withColumn("group_no", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("group_no > 0").drop("starts")


def robots_rules(files: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """The rules that hold for ``agent``, ``(host, path, is_allow)``, and each host's ``(host, crawl_delay)``.

    Groups that name the agent count, else those for ``*``. A rule is a row however many a file has.
    """
    lines = cut(robots_lines(files), "robots-lines")
    named = F.max((F.col("directive") == "user-agent") & (F.lower("value") == agent.lower()))
    general = F.max((F.col("directive") == "user-agent") & (F.col("value") == "*"))
    seconds = F.col("value").try_cast("double")
    delay = F.max_by(seconds, F.when((F.col("directive") == "crawl-delay") & (seconds >= 0), F.col("pos")))
    groups = lines.groupBy("host", "group_no").agg(named.alias("named"), general.alias("general"), delay.alias("delay"))
    any_named = groups.groupBy("host").agg(F.max("named").alias("any_named"))
    groups = groups.join(any_named, "host").where(F.when(F.col("any_named"), F.col("named")).otherwise(F.col("general")))
    groups = cut(groups.select("host", "group_no", "delay"), "robots-groups")
    rules_ = (
        lines.where(F.col("directive").isin("allow", "disallow") & (F.col("value") != ""))
        .join(groups, ["host", "group_no"], "left_semi")
        .groupBy("host", F.col("value").alias("path"))
        .agg(F.max(F.col("directive") == "allow").alias("is_allow"))
    )
    delays = groups.groupBy("host").agg(F.min_by("delay", F.when(F.col("delay").isNotNull(), F.col("group_no"))).alias("crawl_delay"))
    return cut(rules_, "robots-rules"), delays


def _pattern(path: Column) -> Column:
    body = F.regexp_replace(path, r"\$$", "")
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    end = F.when(path.endswith("$"), "$").otherwise("")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), end)


def robots_decision(links: DataFrame, files: DataFrame, agent: str, value: str = "url") -> DataFrame:
    """Add ``allowed``, the deciding rule and the crawl delay for each link.

    ``files(host, text, content_signal)`` has one row per host. The longest matching path decides,
    allow wins a tie; links of unknown hosts are allowed. A plain rule is a prefix: the prefixes of an
    address, of those lengths that its host's rules have, are looked up by an equi-join, so the cost of
    a link does not grow with a file's rules. Only rules with wildcards are tested by pattern, inside
    the address's row. Each address is decided once.
    """
    rules_, delays = robots_rules(files, agent)
    wild = F.col("path").rlike("[*$]")
    plain = rules_.where(~wild)
    tested = F.struct(
        F.length(F.regexp_replace("path", "[*$]", "")).alias("specificity"), F.col("is_allow"), F.col("path"), _pattern(F.col("path")).alias("pattern")
    )
    by_host = rules_.groupBy("host").agg(
        F.collect_set(F.when(~wild, F.length("path"))).alias("lengths"), F.collect_list(F.when(wild, tested)).alias("wild")
    )
    refused = F.coalesce("content_signal", F.lit("")).rlike(r"(?i)(?:^|[,;\s])search\s*=\s*no(?:$|[,;\s])")
    hosts = files.select("host", refused.alias("refused")).join(delays, "host", "left").join(by_host, "host", "left")

    rows = with_address(links, value, "__link").withColumn("host", F.col("__link.host"))
    rows = rows.withColumn("__target", F.concat("__link.path", "__link.query")).drop("__link")
    targets = rows.where(F.col("host").isNotNull()).select("host", F.col("__target").alias("target")).distinct()
    targets = targets.join(hosts.select("host", "lengths", "wild"), "host")
    fits = F.array_max(F.filter("wild", lambda r: F.regexp_like(F.col("target"), r["pattern"])))
    by_pattern = targets.select("host", "target", fits.alias("r")).where("r IS NOT NULL").select("host", "target", "r.specificity", "r.is_allow", "r.path")
    prefixes = targets.select("host", "target", F.explode("lengths").alias("length")).where("length <= length(target)")
    prefixes = prefixes.select("host", "target", F.expr("left(target, length)").alias("path"))
    by_prefix = prefixes.join(plain, ["host", "path"]).select("host", "target", F.length("path").alias("specificity"), "is_allow", "path")
    deciding = by_prefix.union(by_pattern).groupBy("host", F.col("target").alias("__target")).agg(
        F.max(F.struct("specificity", "is_allow", "path")).alias("__rule")
    )
    joined = rows.join(hosts.select("host", "refused", "crawl_delay"), "host", "left").join(deciding, ["host", "__target"], "left")
    return joined.withColumns(
        {
            "allowed": ~F.coalesce("refused", F.lit(False)) & F.coalesce("__rule.is_allow", F.lit(True)),
            "rule": F.when(F.col("refused"), "search=no").otherwise(F.col("__rule.path")),
        }
    ).drop("__target", "__rule", "refused")
