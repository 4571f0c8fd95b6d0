"""Audits and scores: each gives rows (rule, key, message) or counts, and no row where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = (("high", 0.9), ("medium", 0.7), ("low", 0.4))


def fk_errors(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str, optional: bool = False, sentinels: tuple[str, ...] = ()) -> DataFrame:
    """Keys of a child table without a row in its parent; an optional key may be NULL, and sentinels stand for none."""
    rows = child.select(F.col(key).cast("string").alias("key"))
    if optional:
        rows = rows.where("key is not null")
    if sentinels:
        rows = rows.where(~F.coalesce("key", F.lit("")).isin(*sentinels))
    bad = rows.join(parent.select(F.col(parent_key).cast("string").alias("key")).distinct(), "key", "left_anti")
    return bad.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(rule).alias("rule"), "key", "n_rows")


def duplicate_ids(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").select(F.lit(rule).alias("rule"), "key", "n_rows")


def schema_errors(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (table, row_id, keys) whose keys aren't those of their table in the registry (table, keys), and rows of unknown tables."""
    j = rows.join(registry.withColumnRenamed("keys", "known"), "table", "left")
    missing, extra = F.array_except("known", "keys"), F.array_except("keys", "known")
    message = F.when(F.col("known").isNull(), "unknown table").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(missing), ","))).when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(extra), ",")))
    return j.withColumn("message", message).where("message is not null").select("table", "row_id", "message")


def card_audit(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Claims by importance with how many are linked, and the relations of their links."""
    n = links.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_links"), *(F.count_if(F.col("relation") == r).alias(r) for r in ("supports", "contradicts", "context")))
    j = claims.join(n, "claim_id", "left")
    out = j.groupBy("importance").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("n_links").isNull()).alias("n_uncovered"), *(F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in ("supports", "contradicts", "context")))
    return out.withColumn("blocking", F.when((F.col("importance") == "primary") & (F.col("n_uncovered") > 0), "primary_claims_unmapped").otherwise(""))


def record_rules(d: DataFrame) -> DataFrame:
    """Violations of the form of single decision records."""
    rules = F.array(
        F.when(F.col("case_id").isNull(), "case_id must not be empty"),
        F.when(~F.col("decision_status").isin("decided", "confirmed", "blocked"), "invalid decision_status"),
        F.when(~F.col("confidence").isin("high", "medium", "low"), "confidence must be high, medium, or low"),
        F.when((F.col("decision_status") == "blocked") & (F.col("execution_status") == "completed"), "blocked decision cannot have completed execution"),
    )
    return d.select("case_id", "stage", "seq", F.explode(F.array_compact(rules)).alias("violation"))


def case_rules(d: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """Violations over all records of a case: completed though something is blocked, or without a decided record of a needed stage."""
    c = d.groupBy("case_id").agg(
        F.count_if(F.col("decision_status") == "blocked").alias("blocked"),
        F.count_if(F.col("execution_status") == "completed").alias("completed"),
        *(F.count_if((F.col("stage") == s) & (F.col("decision_status") != "blocked")).alias(f"has_{s}") for s in needed),
    )
    rules = F.array(F.when((F.col("blocked") > 0) & (F.col("completed") > 0), "completed although gates are blocked"), *(F.when((F.col("completed") > 0) & (F.col(f"has_{s}") == 0), f"completed without {s}") for s in needed))
    return c.select("case_id", F.explode(F.array_compact(rules)).alias("violation"))


def matrix_family(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    m = low.contains("m-value") | low.contains("m_value")
    return (
        F.when((low == "") | low.rlike("ambiguous|unknown"), "ambiguous")
        .when(low.contains("estimated"), "estimated_counts")
        .when(low.contains("beta") & ~m, "methylation_beta")
        .when(low.rlike("log|rma") | m, "log_scale")
        .when(low.rlike("fpkm|tpm|rpkm|linear|intensity"), "linear_normalized")
        .when(low.rlike("count|raw"), "raw_counts")
        .otherwise("other")
    )


def method_family(c: Column) -> Column:
    """Family of the method named first."""
    name = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)^\s*(limma[- ]?voom|voom|deseq2|edger|limma|none|null|not_run)\b", 1))
    return (
        F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "none").when(name == "", "other").when(name.contains("voom") | name.isin("deseq2", "edger"), "count").when(name == "limma", "log_linear").otherwise("none")
    )


def confidence_value(c: Column) -> Column:
    """Words as numbers; numbers as they are."""
    out = c.try_cast("double")
    for word, v in CONFIDENCE:
        out = F.when(F.lower(F.trim(c)) == word, v).otherwise(out)
    return out


def link_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Relation accuracy, false support and coverage of predicted links (claim_id, evidence_id, relation) against gold ones."""
    g = gold.select("claim_id", "evidence_id", F.col("relation").alias("g"))
    p = predicted.select("claim_id", "evidence_id", F.col("relation").alias("p"))
    j = g.join(p, ["claim_id", "evidence_id"], "full_outer")
    return j.agg(
        F.count("g").alias("n_gold"),
        F.count("p").alias("n_predicted"),
        F.count_if(F.col("g") == F.col("p")).alias("n_right"),
        F.count_if((F.col("p") == "supports") & ~F.col("g").eqNullSafe(F.lit("supports"))).alias("false_support"),
        F.round(F.count_if(F.col("g") == F.col("p")) / F.count("g"), 6).alias("accuracy"),
    )


def gate_score(checks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted share of passed checks (key, check, passed) and the names that failed."""
    w = F.lit(None).cast("double")
    for k, v in weights.items():
        w = F.when(F.col("check") == k, v).otherwise(w)
    c = checks.withColumn("w", F.coalesce(w, F.lit(1.0)))
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",")
    return c.groupBy("key").agg(F.round(F.sum(F.when(F.col("passed"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("score"), failed.alias("blocking"))


def rerun_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of two runs side by side, and whether they are the same."""
    x, y = (t.select(key, F.col(value).alias(n)) for t, n in ((a, "first"), (b, "second")))
    return x.join(y, key, "full_outer").withColumn("same", F.col("first").eqNullSafe(F.col("second")))


def table_fill(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows, cells and cells with a value."""
    filled = sum((F.count(c) for c in columns[1:]), F.count(columns[0]))
    return rows.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) * len(columns)).alias("n_cells"), filled.alias("n_filled"))


def recount(expected: DataFrame, actual: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys whose archived count isn't what a recount gives, or that one side lacks."""
    e, a = expected.select(*keys, F.col(column).alias("expected")), actual.select(*keys, F.col(column).alias("actual"))
    return e.join(a, keys, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def verdict_histogram(rows: DataFrame, verdict: str, kinds: str) -> DataFrame:
    """Rows by verdict and by each of the kinds joined with +."""
    return rows.select(F.col(verdict).alias("verdict"), F.explode(F.split(kinds, r"\+")).alias("kind")).groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"))


def scorecard(scored: DataFrame) -> DataFrame:
    """Verdict counts and rates by method, overall and by class."""
    right, wrong, refused = (F.count_if(F.col("verdict") == v) for v in ("correct", "reversed", "refused"))
    n = F.count(F.lit(1))
    sets = scored.groupingSets([[F.col("method"), F.col("class")], [F.col("method")]], "method", "class").agg(n.alias("n"), right.alias("correct"), F.round(right / n, 6).alias("accuracy"), F.round(wrong / n, 6).alias("wrong_rate"), F.round(refused / n, 6).alias("refusal_rate"))
    return sets.withColumn("class", F.coalesce("class", F.lit("all")))


def arm_summary(calls: DataFrame) -> DataFrame:
    """Rates and means of repeated calls by arm, and the most frequent verdict (ties to the first by name)."""
    v = calls.groupBy("arm", "verdict").agg(F.count(F.lit(1)).alias("c"))
    modal = v.groupBy("arm").agg(F.max_by("verdict", F.struct("c", F.col("verdict"))).alias("modal"))
    s = calls.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("resolved").cast("double")), 6).alias("resolved_rate"), F.round(F.avg("tokens"), 4).alias("mean_tokens"))
    return s.join(modal, "arm")


def provider_stability(runs: DataFrame) -> DataFrame:
    """Pairs of providers (provider, key, value): keys both have, and how many values are the same."""
    a, b = (runs.select("key", F.col("provider").alias(f"provider_{x}"), F.col("value").alias(f"value_{x}")) for x in "ab")
    j = a.join(b, "key").where("provider_a < provider_b")
    same = F.count_if(F.col("value_a").eqNullSafe(F.col("value_b")))
    return j.groupBy("provider_a", "provider_b").agg(F.count(F.lit(1)).alias("n_common"), same.alias("n_same"), F.round(same / F.count(F.lit(1)), 6).alias("agreement"))


def untrusted_support(links: DataFrame, trust: DataFrame) -> DataFrame:
    """Links that support a claim by evidence that isn't trusted (evidence_id, trusted)."""
    return links.where("relation = 'supports'").join(trust.where("not trusted"), "evidence_id", "left_semi").select("claim_id", "evidence_id", F.lit("untrusted evidence cannot support").alias("message"))


def artifact_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Paths (path, digest) that are missing, unexpected or of another content."""
    j = expected.select("path", F.col("digest").alias("e")).join(found.select("path", F.col("digest").alias("a")), "path", "full_outer").where(~F.col("e").eqNullSafe(F.col("a")))
    return j.select("path", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("digest mismatch").alias("message"))


def said_and_own_counts(findings: DataFrame, results: DataFrame, alpha: float) -> DataFrame:
    """By study how many features go up and down by the paper's findings and by the own results."""
    p = findings.groupBy("study_id").agg(F.count_if(F.col("direction") == "up").alias("up"), F.count_if(F.col("direction") == "down").alias("down"))
    sig = F.col("padj") < alpha
    o = results.groupBy("study_id").agg(F.count_if(sig & (F.col("log2fc") > 0)).alias("own_up"), F.count_if(sig & (F.col("log2fc") < 0)).alias("own_down"))
    return p.join(o, "study_id", "left")
