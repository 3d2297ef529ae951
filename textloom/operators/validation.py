"""Violations of reviewed rows, policies, histories, and between tables; tables of errors, never exceptions in tasks."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.review import valid_iso_day


def _given(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit(""))


def _broken(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]), lambda r: r.isNotNull())


def reviewed_violations(rows: DataFrame, slugs: list[str], strategies: list[str], buckets: list[str], bases: list[str]) -> DataFrame:
    """line, ip and rule of each broken rule of reviewed rows (text columns); a key counts as repeated after its first sound row."""
    ip = _given("ip")
    slug, rest = F.substring_index(ip, ":", 1), F.substring(ip, F.instr(ip, ":") + 1, F.length(ip))
    count = _given("extracted_target_count")
    listed = lambda name, allowed: (_given(name) != "") & (_given(name) != "-") & ~_given(name).isin(allowed)
    rules = {
        "bad key": ~(F.contains(ip, F.lit(":")) & (rest != "") & slug.isin(slugs)),
        "no reviewer": _given("reviewer") == "",
        "bad review day": (_given("reviewed_at") != "") & ~valid_iso_day(_given("reviewed_at")),
        "bad target count": (count != "") & ~count.rlike(r"^\+?\d+$"),
        "unknown strategy": (_given("sampling_strategy") != "") & ~_given("sampling_strategy").isin(strategies),
        "unknown bucket": listed("density_bucket", buckets),
        "unknown basis": listed("density_basis", bases),
        "bad creation day": (_given("created") != "") & ~valid_iso_day(_given("created")),
    }
    checked = rows.select("line", ip.alias("ip"), _broken(rules).alias("rules"))
    sound = F.size("rules") == 0
    first = checked.filter(sound).groupBy("ip").agg(F.min("line").alias("first"))
    repeated = checked.filter(sound).join(first, "ip").filter("line > first").select("line", "ip", F.lit("duplicate").alias("rule"))
    return checked.select("line", "ip", F.explode("rules").alias("rule")).unionByName(repeated)


def policy_warnings(rows: DataFrame, required_types: dict[str, str | None], examples: int = 5) -> DataFrame:
    """kind, slug, n and examples of reviewed rows (line, ip, type) outside a policy of sources and their required types."""
    ip = _given("ip")
    slug, kind = F.substring_index(ip, ":", 1), _given("type")
    wanted = F.element_at(F.create_map(*chain.from_iterable((F.lit(s), F.lit(t)) for s, t in required_types.items())), slug)
    needs = F.coalesce(wanted, F.lit("")) != ""
    problem = F.when(~slug.isin(list(required_types)), "source").when(needs & (kind == ""), "unknown type").when(needs & (kind != wanted), "type")
    shown = F.when(problem == "type", F.format_string("%s (%s)", ip, kind)).otherwise(ip)
    found = rows.filter(F.contains(ip, F.lit(":"))).select("line", problem.alias("kind"), F.when(problem != "source", slug).otherwise("").alias("slug"), shown.alias("shown")).filter("kind is not null")
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "slug").orderBy("line")))
    some = ranked.filter(F.col("_n") <= examples).groupBy("kind", "slug").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "shown"))), lambda x: x["shown"]).alias("some"))
    total = found.groupBy("kind", "slug").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > examples, F.concat(F.lit(", +"), F.col("n") - examples, F.lit(" more"))).otherwise("")
    return total.join(some, ["kind", "slug"]).select("kind", "slug", "n", F.concat(F.array_join("some", ", "), more).alias("examples"))


def _day(c: Column) -> Column:
    return F.when(valid_iso_day(c), c)


def consistency_errors(curated: DataFrame, reviewed: DataFrame, metadata: DataFrame) -> DataFrame:
    """line and rule of curated edges (line, source, target, reviewed_at) that reviewed rows (ip, reviewed_at, created) or metadata (key, created, last_commit) contradict."""
    edges = curated.filter((_given("source") != "") & (_given("target") != ""))
    by_source = reviewed.select(F.col("ip").alias("source"), F.lit(True).alias("known"), _day(F.col("reviewed_at")).alias("source_day")).dropDuplicates(["source"])
    by_target = reviewed.select(F.col("ip").alias("target"), F.nullif("created", F.lit("")).alias("given")).dropDuplicates(["target"])
    commits = metadata.select(F.col("key").alias("source"), _day(F.col("last_commit")).alias("last"))
    created = metadata.select(F.col("key").alias("target"), F.col("created").alias("found"))
    full = edges.join(by_source, "source", "left").join(by_target, "target", "left").join(commits, "source", "left").join(created, "target", "left")
    born = _day(F.coalesce("given", "found"))
    rules = {
        "source not reviewed": F.col("known").isNull(),
        "reviewed before its edge": F.col("known").isNotNull() & (F.col("source_day") < _day(F.col("reviewed_at"))),
        "target newer than source": F.col("known").isNotNull() & (born > F.col("last")),
    }
    return full.select("line", F.explode(_broken(rules)).alias("rule"))


def history_violations(docs: DataFrame) -> DataFrame:
    """id and rule of documents (id, history: rows of fields, events: commit, path, date) whose history breaks its shape."""
    rules = {
        "history row too short": F.exists("history", lambda r: F.size(r) < 3),
        "history without commit": F.exists("history", lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")) == ""),
        "bad event day": F.exists("events", lambda e: ~valid_iso_day(e["date"])),
        "event without path": F.exists("events", lambda e: (F.coalesce(e["commit"], F.lit("")) != "") & (F.coalesce(e["path"], F.lit("")) == "")),
    }
    return docs.select("id", F.explode(_broken(rules)).alias("rule"))


def needs_paths(events: Column) -> Column:
    """Whether any event has a commit but no path, so that its file must be looked up again."""
    return F.coalesce(F.exists(events, lambda e: (F.coalesce(e["commit"], F.lit("")) != "") & (F.coalesce(e["path"], F.lit("")) == "")), F.lit(False))


def stale_payload(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows that only the stored or only the newly computed payload has, repeats counted, with side."""
    computed = computed.select(*stored.columns)
    return stored.exceptAll(computed).withColumn("side", F.lit("stored")).unionByName(computed.exceptAll(stored).withColumn("side", F.lit("computed")))


def contract_gaps(columns: list[str], required: list[str]) -> list[str]:
    """Columns that a payload's contract asks for and the payload lacks."""
    return [c for c in required if c not in columns]


def raise_on_errors(errors: DataFrame, most: int = 20) -> None:
    """The strict form of a loader: raises with the number of errors and the first ones."""
    n = errors.count()
    if n:
        shown = "; ".join(": ".join(map(str, r)) for r in errors.orderBy(*errors.columns).limit(most).collect())
        raise ValueError(f"{n} errors: {shown}")


def error_stats(rows: DataFrame, errors: DataFrame, line: str = "line") -> DataFrame:
    """rows, rows with errors, and errors of a validated table: one row."""
    bad = errors.agg(F.countDistinct(line).alias("rows_with_errors"), F.count("*").alias("errors"))
    return rows.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(bad))  # one row each
