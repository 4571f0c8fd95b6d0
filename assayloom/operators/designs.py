"""Study design from attribute tables (study_id, sample_id, attr, ord, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.columns import is_blank
from assayloom.operators.results import first_by

#: Words that mark a design axis, and words that describe the organism.
DESIGN = (
    "treatment", "condition", "time", "timepoint", "time point", "group", "dose", "dosage", "exercise", "training", "intervention", "stimulus", "diet", "agent", "drug", "protocol", "duration",
    "exposure", "regimen", "infection", "stimulation", "genotype", "phenotype", "disease", "status", "arm", "challenge", "knockout",
)
DESCRIPTOR = ("sex", "gender", "age", "stage", "strain", "background", "species", "organism", "tissue", "race", "ethnicity", "ancestry", "breed", "cell type", "cell line")
USUAL = ("characteristics", "title", "source", "treatment", "group", "condition")


def any_of(c, words):
    return F.lower(c).rlike("|".join(words))


def column_scores(a: DataFrame) -> DataFrame:
    """Score of each attribute as the design column; constant, unique and mostly unique ones aren't candidates."""
    n = a.groupBy("study_id").agg(F.countDistinct("sample_id").alias("n"))
    v = a.where(F.col("value").isNotNull() & (F.trim("value") != "")).groupBy("study_id", "attr", "value").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("ord"))
    s = v.groupBy("study_id", "attr").agg(F.count(F.lit(1)).alias("levels"), F.min("size").alias("least"), F.max("size").alias("most"), F.min("ord").alias("ord")).join(n, "study_id")
    fits = (F.col("levels") >= 2) & (F.col("levels") < F.col("n")) & (F.col("levels") <= F.greatest(F.lit(2), F.floor(F.col("n") * 0.8)))
    axis, plain = any_of(F.col("attr"), DESIGN), any_of(F.col("attr"), DESCRIPTOR)
    score = 1 + F.when(axis, 2).otherwise(0) - F.when(plain & ~axis, 1).otherwise(0) + F.when((F.col("least") >= 2) & (F.col("most") / F.col("least") <= 4), 1).otherwise(0) - F.when(any_of(F.col("attr"), USUAL), 0).otherwise(2)
    return s.where(fits).withColumn("score", score)


def pick_design(a: DataFrame) -> DataFrame:
    """The best column of each study with a score of 1 or more; more levels, then the earlier column."""
    best = first_by(column_scores(a), ["study_id"], F.desc("score"), F.desc("levels"), "ord", "attr")
    return best.where("score >= 1").select("study_id", "attr", "score", "levels")


def check_grouping(a: DataFrame, factor: str) -> DataFrame:
    """Whether a factor is there, without blanks, and has two levels or more."""
    studies = a.select("study_id").distinct()
    f = a.where(F.col("attr") == factor).groupBy("study_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_blank("value")).alias("n_blank"), F.countDistinct(F.when(~is_blank("value"), F.col("value"))).alias("levels"))
    j = studies.join(f, "study_id", "left")
    problem = F.when(F.col("n").isNull(), "not in metadata").when(F.col("n_blank") > 0, "blank values").when(F.col("levels") < 2, "one level only")
    return j.select("study_id", F.coalesce("n_blank", F.lit(0)).alias("n_blank"), F.coalesce("levels", F.lit(0)).alias("levels"), F.when(problem.isNull(), "pass").otherwise("fail").alias("status"), F.coalesce(problem, F.lit("")).alias("problem"))


def level_order(a: DataFrame, attr: str) -> DataFrame:
    """Levels of an attribute, controls first, then by the number in them, then by name."""
    v = a.where((F.col("attr") == attr) & ~is_blank("value")).select("study_id", "value").distinct()
    number = F.expr("try_cast(nullif(regexp_extract(value, '(\\\\d+(?:\\\\.\\\\d+)?)', 1), '') as double)")
    control = F.lower("value").rlike("control|baseline|sham|vehicle|untreated|sedentary|pre$")
    w = Window.partitionBy("study_id").orderBy(F.desc("is_control"), F.col("number").asc_nulls_last(), "value")
    return v.withColumn("number", number).withColumn("is_control", control).withColumn("place", F.row_number().over(w).cast("long"))


def confounding(a: DataFrame, primary: str) -> DataFrame:
    """How each attribute relates to the primary factor."""
    p = a.where(F.col("attr") == primary).select("study_id", "sample_id", F.col("value").alias("p"))
    j = a.where(F.col("attr") != primary).join(p, ["study_id", "sample_id"])
    base = j.groupBy("study_id", "attr").agg(F.countDistinct("value").alias("levels"), F.count(F.lit(1)).alias("n"))
    per_value = j.groupBy("study_id", "attr", "value").agg(F.countDistinct("p").alias("c")).groupBy("study_id", "attr").agg(F.max("c").alias("most_p"))
    per_p = j.groupBy("study_id", "attr", "p").agg(F.countDistinct("value").alias("c")).groupBy("study_id", "attr").agg(F.max("c").alias("most_v"))
    kind = (
        F.when(F.col("levels") <= 1, "constant")
        .when(F.col("levels") == F.col("n"), "identifier")
        .when((F.col("most_p") == 1) & (F.col("most_v") == 1), "complete")
        .when(F.col("most_p") == 1, "nested_in_primary")
        .when(F.col("most_v") == 1, "primary_nested_in_it")
        .otherwise("crossed")
    )
    return base.join(per_value, ["study_id", "attr"]).join(per_p, ["study_id", "attr"]).select("study_id", "attr", "levels", kind.alias("relation"))


def pairing(s: DataFrame, levels: list[str]) -> DataFrame:
    """Complete, incomplete and duplicated subjects over the levels of the condition."""
    c = s.where(F.col("condition").isin(levels)).groupBy("study_id", "subject").agg(F.countDistinct("condition").alias("k"), F.count(F.lit(1)).alias("n"))
    full = (F.col("k") == len(levels)) & (F.col("n") == len(levels))
    r = c.groupBy("study_id").agg(F.count_if(full).alias("complete"), F.count_if(F.col("k") < len(levels)).alias("incomplete"), F.count_if(F.col("n") > F.col("k")).alias("duplicated"))
    return r.withColumn("paired", (F.col("complete") > 0) & (F.col("incomplete") == 0) & (F.col("duplicated") == 0))


def complete_pairs(m: DataFrame, s: DataFrame, levels: list[str]) -> DataFrame:
    """The measures of subjects with one sample at every level."""
    c = s.where(F.col("condition").isin(levels)).groupBy("study_id", "subject").agg(F.countDistinct("condition").alias("k"), F.count(F.lit(1)).alias("n")).where(f"k = {len(levels)} and n = {len(levels)}")
    kept = s.join(c, ["study_id", "subject"], "left_semi").select("study_id", "sample_id")
    return m.join(kept, ["study_id", "sample_id"], "left_semi")


def two_arm(s: DataFrame, m: DataFrame, control: str, treatment: str, least: int = 2, share: float = 0.5) -> DataFrame:
    """Whether a two-arm contrast can be run: replicates, and enough of each arm in the matrix."""
    there = m.select("study_id", "sample_id").distinct().withColumn("there", F.lit(1))
    j = s.join(there, ["study_id", "sample_id"], "left")
    arm = lambda v, x: F.count_if((F.col("condition") == v) & x)
    c = j.groupBy("study_id").agg(*(arm(v, F.lit(True)).alias(f"n_{k}") for k, v in (("control", control), ("treated", treatment))), *(arm(v, F.col("there").isNotNull()).alias(f"aligned_{k}") for k, v in (("control", control), ("treated", treatment))))
    reason = F.when(F.least("aligned_control", "aligned_treated") < least, "too few replicates").when((F.col("aligned_control") < share * F.col("n_control")) | (F.col("aligned_treated") < share * F.col("n_treated")), "arm not aligned")
    return c.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("valid", reason.isNull())


def covariance_decisions(a: DataFrame, primary: str, subject: str) -> DataFrame:
    """What to do with each further attribute in a model of the primary factor."""
    c = confounding(a, primary)
    s = a.where(F.col("attr") == primary).select("study_id", "sample_id", F.col("value").alias("condition")).join(a.where(F.col("attr") == subject).select("study_id", "sample_id", F.col("value").alias("subject")), ["study_id", "sample_id"])
    k = s.groupBy("study_id", "subject").agg(F.countDistinct("condition").alias("k")).groupBy("study_id").agg((F.min("k") >= 2).alias("within"))
    is_subject = F.col("attr") == subject
    what = (
        F.when(is_subject & F.col("within"), "block")
        .when(is_subject, "between_subjects")
        .when(F.col("relation").isin("constant", "identifier"), "omit")
        .when(F.col("relation") == "complete", "stop")
        .when(F.col("relation").isin("nested_in_primary", "primary_nested_in_it"), "check")
        .otherwise("candidate")
    )
    return c.join(k, "study_id").select("study_id", "attr", "relation", what.alias("decision"))


def pairing_signal(a: DataFrame, primary: str) -> DataFrame:
    """Attributes with at least two values that recur in several arms of the primary factor."""
    p = a.where(F.col("attr") == primary).select("study_id", "sample_id", F.col("value").alias("p"))
    v = a.where(F.col("attr") != primary).join(p, ["study_id", "sample_id"]).groupBy("study_id", "attr", "value").agg(F.countDistinct("p").alias("arms"), F.count(F.lit(1)).alias("n"))
    s = v.groupBy("study_id", "attr").agg(F.count_if(F.col("arms") >= 2).alias("n_recurring"), F.max("n").alias("most"))
    return s.where((F.col("n_recurring") >= 2) & (F.col("most") <= 4)).select("study_id", "attr", "n_recurring")


def strata_scan(a: DataFrame) -> DataFrame:
    """Attributes named for time or dose with two levels or more."""
    return a.where(any_of(F.col("attr"), ("time", "dose", "age", "day", "week"))).groupBy("study_id", "attr").agg(F.countDistinct("value").alias("levels")).where("levels >= 2")


#: Markers of a baseline level as whole words, and of columns that can hold the design.
BASELINE = ("pre", "baseline", "basal", "sedentary", "untrained", "sham", "control", "vehicle", "naive", "wildtype", "wild-type")
DESIGN_NAMES = ("characteristics", "title", "source", "treatment", "group", "condition", "phenotype", "time")


def detect_contrasts(a: DataFrame, treatment: list[str], control: list[str], least: int = 2, every: bool = False) -> DataFrame:
    """Control against every treatment level of the best column of each study.

    A level is a control if it holds a control word and no treatment word, or a baseline marker as a whole word beside it; a treatment level
    holds treatment words only. Columns with 2 to 8 levels and a usable pair score by their name and by arms of three or more. With ``every``
    the pairs of all usable columns are returned.
    """
    v = a.where(F.col("value").isNotNull() & any_of(F.col("attr"), DESIGN_NAMES)).groupBy("study_id", "attr", "value").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.min("sample_id").alias("first"))
    few = v.groupBy("study_id", "attr").agg(F.count(F.lit(1)).alias("levels")).where("levels between 2 and 8")
    low = F.lower("value")
    is_c, is_t = low.rlike("|".join(control)), low.rlike("|".join(treatment))
    base = low.rlike(r"\b(" + "|".join(BASELINE) + r")\b")
    role = F.when(is_c & (~is_t | base), "control").when(is_t & ~is_c, "treatment")
    r = v.join(few, ["study_id", "attr"]).withColumn("role", role)
    c = first_by(r.where("role = 'control'"), ["study_id", "attr"], "first", "value").where(F.col("n") >= least).select("study_id", "attr", F.col("value").alias("control"), F.col("n").alias("n_control"))
    t = r.where((F.col("role") == "treatment") & (F.col("n") >= least)).select("study_id", "attr", "ord", F.col("value").alias("treatment"), F.col("n").alias("n_treatment"))
    j = t.join(c, ["study_id", "attr"])
    if every:
        return j
    s = j.groupBy("study_id", "attr").agg(F.count(F.lit(1)).alias("k"), F.min(F.least("n_control", "n_treatment")).alias("least"), F.min("ord").alias("ord"))
    score = 1 + any_of(F.col("attr"), ("treatment", "condition", "time")).cast("int") + (F.col("least") >= 3).cast("int")
    best = first_by(s.withColumn("score", score), ["study_id"], F.desc("score"), F.desc("k"), "ord", "attr").select("study_id", "attr", "score")
    return j.join(best, ["study_id", "attr"]).select("study_id", "attr", "control", "treatment", "n_control", "n_treatment", "score")


def confident(contrasts: DataFrame, viable: DataFrame, least: int = 3) -> DataFrame:
    """A study is certain if one column only can hold its design and all arms have ``least`` samples."""
    n = viable.groupBy("study_id").agg(F.countDistinct("attr").alias("n_columns"))
    c = contrasts.groupBy("study_id").agg(F.min(F.least("n_control", "n_treatment")).alias("least"))
    return c.join(n, "study_id").select("study_id", "n_columns", "least", ((F.col("n_columns") == 1) & (F.col("least") >= least)).alias("confident"))


def split_study(a: DataFrame, attr: str, pairing: str = "all", most: int | None = None) -> DataFrame:
    """A study for each level of an attribute, and the comparisons between them.

    ``all`` pairs every two levels, ``baseline`` each other level with each baseline one, ``baseline+adjacent`` each level with the first
    baseline and every level with the one before it. Baseline levels come first, so the control is always the earlier of a pair. ``most``
    keeps the first comparisons of a study, in the order of their enumeration.
    """
    o = level_order(a, attr)
    n = a.where(F.col("attr") == attr).groupBy("study_id", "value").agg(F.count(F.lit(1)).alias("n"))
    o = o.join(n, ["study_id", "value"])
    x, y = (o.select("study_id", F.col("value").alias(k), F.col("place").alias(f"place_{k}"), F.col("n").alias(f"n_{k}"), F.col("is_control").alias(f"base_{k}")) for k in ("control", "treatment"))
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    j = x.join(y, "study_id").where("place_control < place_treatment")
    if pairing == "baseline":
        j = j.where("base_control and not base_treatment")
    elif pairing == "baseline+adjacent":
        j = j.withColumn("first", F.col("base_control") & (F.col("place_control") == 1)).where(F.col("first") | (F.col("place_control") + 1 == F.col("place_treatment")))
    elif pairing != "all":
        raise ValueError("pairing is all, baseline or baseline+adjacent")
    if most is not None:
        order = [F.desc("first"), "place_treatment"] if pairing == "baseline+adjacent" else ["place_control", "place_treatment"]
        j = j.withColumn("nth", F.row_number().over(Window.partitionBy("study_id").orderBy(*order))).where(F.col("nth") <= most)
    return j.select("study_id", F.concat_ws("__", "study_id", slug(F.col("control"))).alias("control_study"), F.concat_ws("__", "study_id", slug(F.col("treatment"))).alias("treatment_study"), "control", "treatment", F.least("n_control", "n_treatment").alias("least_n"), (F.col("n_control") + F.col("n_treatment")).alias("both_arms_n"))


def planned_sizes(s: DataFrame, planned: DataFrame, least: int = 3) -> DataFrame:
    """(study_id, planned, n, verdict): samples of each planned condition; names are compared without case, white space and underscores.

    A planned name without samples is unknown.
    """
    key = lambda c: F.regexp_replace(F.lower(c), r"[\s_-]+", "")
    n = s.groupBy("study_id", key(F.col("condition")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    j = planned.select("study_id", "planned", key(F.col("planned")).alias("key")).join(n, ["study_id", "key"], "left")
    return j.select("study_id", "planned", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "unknown").when(F.col("n") >= least, "enough").otherwise("too_small").alias("verdict"))


def sex_split(s: DataFrame, least: int = 3) -> DataFrame:
    """Per sex the sizes of both arms and whether it can be analysed on its own; ``s`` has study_id, condition, sex."""
    c = s.where("sex is not null").groupBy("study_id", "sex", "condition").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("study_id", "sex").agg(F.count(F.lit(1)).alias("n_arms"), F.min("n").alias("least")).withColumn("analyzable", (F.col("n_arms") >= 2) & (F.col("least") >= least))


def suitability(checks: DataFrame) -> DataFrame:
    """One verdict a study from its checks (study_id, check, status): fail if any fails."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.col("check")))), ";")
    return checks.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("status") == "fail").alias("n_failed"), failed.alias("failed")).withColumn("verdict", F.when(F.col("n_failed") > 0, "fail").otherwise("pass"))


def design_rank(s: DataFrame, terms: list[str]) -> DataFrame:
    """Samples, rank of the design, parameters and residual degrees of freedom of each study.

    The factor with most levels is taken out first: its levels are independent, and what the other terms add is the rank of their products
    within its levels, which are sums. So a study's task sees a square of the columns of all other terms, whatever the samples.
    """
    import numpy as np
    import pandas as pd

    kind = dict(s.dtypes)
    numbers = [t for t in terms if kind[t] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    factors = [t for t in terms if t not in numbers]
    s = s.select("study_id", *(F.col(t).cast("double").alias(t) for t in numbers), *(F.coalesce(F.col(t).cast("string"), F.lit("None")).alias(t) for t in factors))
    found = s.agg(*(F.approx_count_distinct(t).alias(t) for t in factors)).first().asDict() if factors else {}
    largest = max(factors, key=lambda t: found[t], default=None)
    s = s.withColumn("__a", F.col(largest) if largest else F.lit(""))
    levels = s.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("__a").alias("a"), *(F.countDistinct(t).alias(f"l{i}") for i, t in enumerate(factors)))
    columns = sum((F.col(f"l{i}") - 1 for i in range(len(factors))), F.lit(1 + len(numbers)))
    rest = [t for t in terms if t != largest]
    if not rest:
        extra = s.select("study_id").limit(0).withColumn("extra", F.lit(0))
    else:
        column = lambda t: F.struct(F.lit(t).alias("t"), (F.lit("") if t in numbers else F.col(t)).alias("l"), (F.col(t) if t in numbers else F.lit(1.0)).alias("v"))
        z = s.select("study_id", "__a", F.array(*map(column, rest)).alias("z"))
        both = lambda of, by: F.flatten(F.transform(of, lambda x: F.transform(of, lambda y: F.struct(F.concat_ws("=", x["t"], x["l"]).alias("i"), F.concat_ws("=", y["t"], y["l"]).alias("j"), (x["v"] * y["v"]).alias("whole"), by(x["v"] * y["v"]).alias("g")))))
        sums = z.select("study_id", "__a", F.explode("z").alias("z")).groupBy("study_id", "__a", "z.t", "z.l").agg(F.sum("z.v").alias("v"), F.count(F.lit(1)).alias("k"))
        of_level = sums.groupBy("study_id", "__a").agg(F.collect_list(F.struct("t", "l", "v")).alias("z"), (F.sum("k") / len(rest)).alias("k"))
        own = z.select("study_id", F.explode(both(F.col("z"), lambda v: v)).alias("p"))
        less = of_level.select("study_id", F.explode(both(F.col("z"), lambda v: -v / F.col("k"))).alias("p")).withColumn("p", F.col("p").withField("whole", F.lit(0.0)))
        products = own.union(less).groupBy("study_id", "p.i", "p.j").agg(F.sum("p.whole").alias("whole"), F.sum("p.g").alias("g"))

        def one(p: pd.DataFrame) -> pd.DataFrame:
            g = p.pivot(index="i", columns="j", values="g").fillna(0.0)
            at = p[p["i"] == p["j"]].set_index("i")["whole"].reindex(g.index).to_numpy(float)
            scale = np.sqrt(np.where(at > 0, at, 1.0))
            x = g[g.index].to_numpy(float) / scale[:, None] / scale[None, :]
            return pd.DataFrame({"study_id": [p["study_id"].iloc[0]], "extra": [int((np.linalg.eigvalsh(x) > 1e-12 * len(x)).sum())]})

        extra = products.groupBy("study_id").applyInPandas(one, f"study_id {kind['study_id']}, extra int")
    j = levels.join(extra, "study_id", "left").withColumn("rank", F.col("a") + F.coalesce("extra", F.lit(0)))
    return j.select("study_id", F.col("n").alias("n_samples"), columns.cast("long").alias("n_columns"), "rank", (F.col("n") - F.col("rank")).alias("residual_df"))


def multifactor_plan(s: DataFrame, terms: list[str]) -> DataFrame:
    """Per study the samples without gaps, terms with one level only, rank and degrees of freedom, and whether the plan stands."""
    whole = s
    for t in terms:
        whole = whole.where(~is_blank(t))
    levels = whole.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_compact(F.array(*(F.when(F.countDistinct(t) < 2, t) for t in terms))), ";").alias("dropped"))
    r = design_rank(whole, terms).select("study_id", "rank", "n_columns", "residual_df")
    return levels.join(r, "study_id").withColumn("valid", (F.col("rank") == F.col("n_columns")) & (F.col("residual_df") >= 2))


def series_screen(rows: DataFrame, layers: list[tuple[str, object]]) -> DataFrame:
    """First failing layer of each series, and of each paper the series that came furthest; layers are conditions in order."""
    n = F.lit(len(layers))
    for k, (_, ok) in reversed(list(enumerate(layers))):
        n = F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)).otherwise(n)
    names = F.array(*(F.lit(x) for x, _ in layers), F.lit("analyzable"))
    r = rows.withColumn("depth", n)
    p = r.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_series"), F.max("depth").alias("depth"), F.count_if(F.col("depth") == len(layers)).alias("n_analyzable"))
    return p.select("paper_id", "n_series", "n_analyzable", F.element_at(names, F.col("depth") + 1).alias("reason"))


def header_groups(a: DataFrame) -> DataFrame:
    """The design column of each study, its smallest group and the sexes recorded."""
    from assayloom.functions.columns import sex_label

    d = pick_design(a).select("study_id", "attr")
    size = a.join(d, ["study_id", "attr"]).groupBy("study_id", "attr", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("study_id", "attr").agg(F.min("n").alias("smallest"), F.count(F.lit(1)).alias("n_groups"))
    sex = a.where("attr = 'sex'").groupBy("study_id").agg(F.array_join(F.array_sort(F.collect_set(sex_label(F.col("value")))), ";").alias("sexes"))
    return size.join(sex, "study_id", "left").withColumn("sexes", F.coalesce("sexes", F.lit("")))
