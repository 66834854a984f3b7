"""Session registries, labels and roll-ups from sessions to subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolock.functions import finite
from chronolock.functions.lineage import stored

# Spellings of quality words, session types and response classes, and channel names.
QUALITY = {"good": "good", "great": "good", "excellent": "good", "ok": "okay", "okay": "okay", "fair": "okay", "poor": "poor", "bad": "poor", "": "unknown", "nan": "unknown", "none": "unknown", "unknown": "unknown"}
SESSION_TYPES = {"familiar": "f", "novel": "n", "novel+": "n+", "novel_plus": "n+"}
CLASSES = {"actrivated": "activated", "no-change": "no_change", "no change": "no_change"}
CHANNELS = {"g": 0, "green": 0, "glu": 0, "glutamate": 0, "r": 1, "red": 1, "ca": 1, "rcamp": 1, "calcium": 1}


def mapped(c: Column, values: dict) -> Column:
    """The value of a mapping, null where it has none."""
    out = F.lit(None)
    for k, v in reversed(values.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def select_sessions(sessions: DataFrame, subjects: list | None = None, types: list | None = None, excluded_types: list | None = None, qualities: list | None = None) -> DataFrame:
    """sessions of the given subjects, types and qualities; a null type is never excluded."""
    cond = F.lit(True)
    for column, values in (("subject_id", subjects), ("session_type", types), ("quality", qualities)):
        if values is not None:
            cond &= F.col(column).isin(*values)
    if excluded_types is not None:
        cond &= ~F.col("session_type").isin(*excluded_types) | F.col("session_type").isNull()
    return sessions.where(cond)


def not_unique(rows: DataFrame, key: str) -> DataFrame:
    """keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def quality_word(c: Column) -> Column:
    """good, okay, poor or unknown; another word as it is, in lower case."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(mapped(word, QUALITY), word)


def class_word(c: Column) -> Column:
    """a response class by its usual spelling."""
    word = F.lower(F.trim(c))
    return F.coalesce(mapped(word, CLASSES), word)


def session_type_word(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.coalesce(mapped(word, SESSION_TYPES), word)


def plane_number(c: Column) -> Column:
    """1 from ``1``, ``1.0``, ``DMD1`` or ``dmd1``; null from anything else."""
    found = F.regexp_extract(F.upper(F.trim(c.cast("string"))), r"^(?:DMD)?(\d+)(?:\.0)?$", 1)
    return F.when(found != "", found.cast("int"))


def depths_long(sessions: DataFrame, columns: dict[str, int]) -> DataFrame:
    """one row for each plane's depth column, nulls left out, repeats once."""
    long = sessions.select("session_id", F.explode(F.array(*[F.struct(F.lit(n).alias("plane"), F.expr(f"try_cast({c} as double)").alias("depth_um")) for c, n in columns.items()])).alias("x")).select("session_id", "x.*")
    return long.where("depth_um is not null").distinct()


def identity(path: Column) -> dict[str, Column]:
    """subject, date and time from ``123456_2024-01-31_12-30-00`` anywhere in a name."""
    shape = r"(\d{6})_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})"
    part = lambda i: F.when(F.regexp_extract(path, shape, i) != "", F.regexp_extract(path, shape, i))
    return {"subject_id": part(1).cast("bigint"), "session_date": F.to_date(part(2)), "session_time": part(3)}


def tolerant_number(c: Column) -> Column:
    """a number, null if it is none or not a number."""
    x = F.expr("null").cast("double") if c is None else c.try_cast("double")
    return F.when(~F.isnan(x), x)


def is_indicator(c: Column) -> Column:
    """whether a name is that of a calcium indicator; null is not."""
    return F.coalesce(c.rlike(r"(?i)^[A-Za-z]*CaMP\d+[A-Za-z0-9._-]*$"), F.lit(False))


def channel_number(c: Column) -> Column:
    """a channel's number from 0, by name or by number from 1."""
    word = F.lower(F.trim(c))
    return F.coalesce(word.try_cast("int") - 1, mapped(word, CHANNELS).cast("int"))


def last_sessions(sessions: DataFrame, n: int = 6, slots: tuple[str, ...] = ("f1", "f2", "f3", "n", "n+1", "n+2")) -> DataFrame:
    """The last ``n`` sessions of each subject, oldest first, with the slot of each."""
    newest = W.partitionBy("subject_id").orderBy(F.desc("session_date"), F.desc("session_id"))
    kept = sessions.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)
    place = F.row_number().over(W.partitionBy("subject_id").orderBy("session_date", "session_id"))
    return kept.withColumn("place", place).withColumn("slot", F.element_at(F.array(*map(F.lit, slots)), F.col("place"))).drop("back")


def extremes(rows: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """The ``n`` worst, middle and best rows of each key by score, with a ``pick`` column."""
    span = W.partitionBy(*keys)
    r = rows.withColumn("r", F.row_number().over(span.orderBy("score", "session_id"))).withColumn("n", F.count("*").over(span))
    middle = F.floor((F.col("n") - n) / 2)
    picks = F.array_compact(F.array(F.when(F.col("r") <= n, F.lit("worst")), F.when((F.col("r") > middle) & (F.col("r") <= middle + n), F.lit("middle")), F.when(F.col("r") > F.col("n") - n, F.lit("best"))))
    return r.withColumn("pick", F.explode(picks)).drop("n")


def quality_overview(sessions: DataFrame) -> DataFrame:
    """Per subject: sessions by quality, latest date, listed types, and an assessment by ordered
    rules."""
    g = sessions.groupBy("subject_id").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == "good").alias("good"), F.count_if(F.col("quality") == "okay").alias("okay"), F.count_if(F.col("quality") == "poor").alias("poor"), F.max("session_date").alias("latest"), F.array_join(F.array_sort(F.collect_set("session_type")), ", ").alias("types"))
    usable = F.col("good") + F.col("okay")
    rule = F.when(F.col("n") == 0, "unclear").when(F.col("good") >= F.floor(0.75 * F.col("n")).cast("bigint"), "strong").when(usable >= F.floor(0.75 * F.col("n")).cast("bigint"), "usable").when(F.col("poor") >= F.expr("n div 2"), "needs review").otherwise("mixed")
    return g.withColumn("assessment", rule)


#: Weight of each part of a session's quality, the value under which it is flagged, the flag.
QUALITY_PARTS = {"glut_pass_fraction": (0.45, 0.40, "low_glut_pass_fraction"), "ca_pass_fraction": (0.20, 0.40, "low_calcium_pass_fraction"), "alignment_ready": (0.20, 1.0, "alignment_failed"), "event_coverage": (0.15, 0.85, "low_event_coverage")}


def overall_quality(parts: DataFrame, rules: dict[str, tuple[float, float, str]] = QUALITY_PARTS) -> DataFrame:
    """``score``: the weighted mean of the parts that are there, each within 0 and 1 (a boolean is 1 or
    0), its tier, the flags of parts under their bar, and whether to review (tiers C and FAIL, and no tier).

    ``rules`` has each part's weight, bar and flag; flags stand in their order."""
    kinds = dict(parts.dtypes)
    values = {c: F.col(c).cast("int").cast("double") if kinds[c] == "boolean" else finite(F.col(c).cast("double")) for c in rules}
    up = sum((F.lit(w) * F.coalesce(F.least(F.greatest(values[c], F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) for c, (w, _, _) in rules.items()), F.lit(0.0))
    down = sum((F.lit(w) * values[c].isNotNull().cast("int") for c, (w, _, _) in rules.items()), F.lit(0.0))
    tier = F.when(F.col("score") >= 0.85, "A").when(F.col("score") >= 0.70, "B").when(F.col("score") >= 0.50, "C").when(F.col("score").isNotNull(), "FAIL")
    flags = F.concat_ws("; ", *[F.when(values[c] < bar, F.lit(flag)) for c, (_, bar, flag) in rules.items()])
    out = parts.withColumn("score", up / F.when(down != 0, down)).withColumn("tier", tier).withColumn("flags", flags)
    return out.withColumn("needs_review", F.col("tier").isNull() | F.col("tier").isin("C", "FAIL"))


def subject_rollup(scored: DataFrame) -> DataFrame:
    """Per subject: sessions, usable ones, those to review, mean score and median parts."""
    return scored.groupBy("subject_id").agg(F.count("*").alias("n_sessions"), F.count_if(F.col("tier").isin("A", "B")).alias("n_usable"), F.count_if("needs_review").alias("n_review"), F.avg("score").alias("mean_score"), F.percentile("score", F.lit(0.5)).alias("median_score"))


def manifest(subjects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Subject and session rows as one table, columns by name."""
    return subjects.withColumn("level", F.lit("subject")).unionByName(sessions.withColumn("level", F.lit("session")), allowMissingColumns=True)


def flatten_json(docs: DataFrame, fields: dict[str, list[str]], body: str = "body") -> DataFrame:
    """Columns from JSON documents: the first of each field's paths that has a value; a document
    that is no object gives nulls."""
    def pick(paths: list[str]) -> Column:
        return F.coalesce(*[F.get_json_object(body, p) for p in paths])

    return docs.withColumns({name: pick(paths) for name, paths in fields.items()})


def shares_by_class(rows: DataFrame, keys: list[str], label: str, classes: list[str]) -> DataFrame:
    """The share of each class, in a fixed order with zeros."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    grid = total.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    both = grid.join(counts.withColumnRenamed(label, "class"), [*keys, "class"], "left")
    return both.select(*keys, "class", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def percent_by_slot(rows: DataFrame, outer: list[str], inner: str, flag: Column) -> DataFrame:
    """Percent with a flag per subject, then mean, deviation, number and standard error over
    subjects."""
    each = rows.groupBy(*outer, inner).agg((100.0 * F.count_if(flag) / F.count("*")).alias("percent"))
    out = each.groupBy(*outer).agg(F.avg("percent").alias("mean"), F.stddev_samp("percent").alias("sd"), F.count("*").alias("n"))
    return out.withColumn("sem", F.col("sd") / F.sqrt("n"))


def reconcile(logged: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Counts of either side, and their difference; keys of one side count 0 on the other."""
    a = logged.groupBy(key).agg(F.count("*").alias("logged"))
    b = extracted.groupBy(key).agg(F.count("*").alias("extracted"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("logged", F.lit(0)).alias("logged"), F.coalesce("extracted", F.lit(0)).alias("extracted"))
    return both.withColumn("difference", F.col("logged") - F.col("extracted"))


def share_of(whole: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key, those of the part (0 if none), and their percent."""
    n = whole.groupBy(*keys).agg(F.count("*").alias("n"))
    m = part.groupBy(*keys).agg(F.count("*").alias("m"))
    return n.join(m, keys, "left").select(*keys, "n", F.coalesce("m", F.lit(0)).alias("m"), (100.0 * F.coalesce("m", F.lit(0)) / F.col("n")).alias("percent"))


def newest(files: DataFrame, keys: list[str]) -> DataFrame:
    """The newest file of each key, the larger path on ties."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime"))


def resolved_assets(sessions: DataFrame, files: DataFrame, rules: dict[str, list[tuple[str, str]]], within: dict[str, str] | None = None) -> DataFrame:
    """``sessions`` with a column for each asset: the file or folder that its rules find, and
    ``<asset>_rule``, the number of the rule that did (from 0); both null where none does.

    ``files`` has ``path`` and ``mtime`` (a manifest).  A rule is a root and a pattern: the name of a column of
    ``sessions`` that holds a folder, and a regular expression for a name anywhere below it.  Rules are tried
    in order, so later roots and patterns are fallbacks; of what one rule finds the newest counts, a
    folder's time being its newest file's, and of equally new ones the larger path.  An asset in ``within`` is
    looked for below the asset named there only.

    Files meet sessions on equal folders: what is named as a rule asks is unrolled into the folders above it, of the
    depths that roots have: what all files lie below is no key of the join unless it is a root.  What is met is
    settled, and one pass over it finds all assets but those within others."""
    within = within or {}
    roots = sorted({root for r in rules.values() for root, _ in r})
    named = sessions.select("session_id", F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.rtrim(F.col(r), F.lit("/")).alias("folder")) for r in roots])).alias("e")).select("session_id", "e.*").where("folder is not null")
    # few: a path has not many steps
    depths = sorted(r[0] for r in named.select(F.size(F.split("folder", "/"))).distinct().collect())
    met = stored(named.join(_entries(files, sorted({p for r in rules.values() for _, p in r}), depths), "folder").select("session_id", "root", "name", "entry", "mtime"))
    hits = {asset: F.coalesce(*[F.when((F.col("root") == root) & F.col("name").rlike(f"^(?:{pattern})$"), F.lit(k)) for k, (root, pattern) in enumerate(rules[asset])]) for asset in rules}

    def best(asset: str) -> Column:
        return F.max(F.when(hits[asset].isNotNull(), F.struct((-hits[asset]).alias("rule"), "mtime", "entry"))).alias(f"_{asset}")

    def told(rows: DataFrame, *assets: str) -> DataFrame:
        for asset in assets:
            rows = rows.withColumn(asset, F.col(f"_{asset}.entry")).withColumn(f"{asset}_rule", -F.col(f"_{asset}.rule")).drop(f"_{asset}")
        return rows

    first = [asset for asset in rules if asset not in within]
    out = told(sessions.join(met.groupBy("session_id").agg(*map(best, first)), "session_id", "left"), *first)
    for asset in [a for a in rules if a in within]:  # what lies within others comes after them
        outer = out.select("session_id", F.col(within[asset]).alias("outer")).where("outer is not null").distinct()
        found = met.where(hits[asset].isNotNull()).join(outer, "session_id").where(F.startswith("entry", F.concat("outer", F.lit("/"))))
        out = told(out.join(found.groupBy("session_id").agg(best(asset)), "session_id", "left"), asset)
    return out


def _entries(files: DataFrame, patterns: list[str], depths: list[int]) -> DataFrame:
    """Files and folders whose name fits a pattern: ``entry, name, mtime``, a row for each ``folder`` above it that is
    as many steps deep as one of ``depths``."""
    asked = "|".join(f"^(?:{p})$" for p in patterns)
    bare = files.select(F.rtrim("path", F.lit("/")).alias("bare"), "mtime")
    steps = bare.select("bare", "mtime", F.posexplode(F.split("bare", "/")).alias("n", "name")).where(F.col("name").rlike(asked))
    entries = steps.select(F.expr("substring_index(bare, '/', n + 1)").alias("entry"), "name", "n", "mtime").where("entry <> ''")
    entries = entries.groupBy("entry", "name", "n").agg(F.max("mtime").alias("mtime"))
    deep = entries.select("*", F.explode(F.array(*map(F.lit, depths)).cast("array<int>")).alias("d")).where(F.col("d") <= F.greatest("n", F.lit(1)))
    return deep.select("entry", "mtime", "name", F.expr("substring_index(entry, '/', d)").alias("folder"))


def session_row(sessions: DataFrame, session_id: object, key: str = "session_id") -> Row:
    """the one row of a session; an error where there is none, or more than one."""
    rows = sessions.where(F.col(key) == F.lit(session_id)).limit(2).collect()
    if not rows:
        raise KeyError(f"no row with {key} {session_id!r}")
    if len(rows) > 1:
        raise ValueError(f"several rows with {key} {session_id!r}")
    return rows[0]


def completeness(sessions: DataFrame, products: list[str], there: DataFrame) -> DataFrame:
    """Each expected product of each session, and whether it is there."""
    want = sessions.select("session_id").distinct().withColumn("product", F.explode(F.array(*map(F.lit, products))))
    have = there.select("session_id", "product").distinct().withColumn("exists", F.lit(True))
    return want.join(have, ["session_id", "product"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def pending(requested: DataFrame, written: DataFrame, overwrite: bool = False) -> DataFrame:
    """K5: requested sessions that are not written yet; all if they may be overwritten."""
    return requested if overwrite else requested.join(written.select("session_id").distinct(), "session_id", "left_anti")


def status(sessions: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """K4: ``status``, the first stage that failed and all reasons, from conditions that should hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return sessions.withColumn("failure_reasons", failed).withColumn("status", F.when(F.size("failure_reasons") == 0, "ok").otherwise("failed")).withColumn("failure_stage", F.try_element_at("failure_reasons", F.lit(1)))
