"""Labels: normalisation, issue-category mapping, validation, sufficiency, governance of mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epistola.functions import domains, similarity, values
from epistola.functions.text import comma_list
from epistola.operators.fuzzy import close_pairs
from epistola.session import stored

# ---- normalisation


def normalize_category(df: DataFrame, column: str = "category", strict: bool = False, cutoff: float = 0.7, fuzzy: bool = True, overlay: DataFrame | None = None) -> DataFrame:
    """Append category_norm, status, match_confidence.

    In order: standard name (exact, 1), misused issue type (issue_type, Others, 0.7), known
    spelling (normalized, 0.95), closest standard name or spelling from `cutoff` on (fuzzy,
    its ratio), else Others at 0.5 or, when strict, a rejection. Work is done on the distinct
    values and joined back. overlay(variant, category) wins over the built-in spellings.
    """
    spark = df.sparkSession
    variants = domains.category_variants(spark)
    if overlay is not None:
        own = overlay.select("variant", F.col("category").alias("__own"))
        variants = variants.join(own, "variant", "full").select("variant", F.coalesce("__own", "category").alias("category"))
    distinct = df.select(F.col(column).alias("__v")).distinct().withColumns({"__t": F.trim("__v"), "__l": F.lower(F.trim("__v"))})
    # the values are few beside the rows, and the closest names are looked up among them in Python: they are made once
    distinct = stored(distinct, "values") if fuzzy else distinct
    known = distinct.join(variants.select(F.col("variant").alias("__l"), F.col("category").alias("__known")), "__l", "left")
    lower = {c.lower(): c for c in domains.CATEGORIES}
    exact = F.when(F.col("__t").isin(*domains.CATEGORIES), F.col("__t"))
    standard = F.lit(None).cast("string")
    for low, name in lower.items():
        standard = F.when(F.col("__l") == low, name).otherwise(standard)
    known = known.withColumns({"__exact": exact, "__known": F.coalesce("__known", standard), "__misused": F.col("__l").isin(*domains.MISUSED_ISSUES)})
    if fuzzy:
        rest = known.where("__exact is null and __known is null and not __misused and __l != ''")
        names = sorted({*lower, *(v for vs in domains.CATEGORY_VARIANTS.values() for v in vs)})
        near = rest.select("__v", similarity.closest(F.col("__l"), names, cutoff).alias("__near")).where("__near.match is not null")
        meaning = variants.select(F.col("variant").alias("__m"), F.col("category").alias("__c"))
        near = near.join(meaning, F.col("__near.match") == F.col("__m"), "left")
        for low, name in lower.items():
            near = near.withColumn("__c", F.coalesce("__c", F.when(F.col("__near.match") == low, name)))
        near = near.select(F.col("__v").alias("__w"), F.col("__c").alias("__near_c"), F.col("__near.ratio").alias("__ratio"))
        known = known.join(near, F.col("__v") == F.col("__w"), "left")
    else:
        known = known.withColumns({"__near_c": F.lit(None).cast("string"), "__ratio": F.lit(None).cast("double")})
    blank = F.coalesce(F.col("__l"), F.lit("")) == ""
    name = F.when(blank, F.lit(None)).otherwise(
        F.coalesce("__exact", F.when(F.col("__misused"), "Others"), "__known", "__near_c", F.lit(None).cast("string") if strict else F.lit("Others"))
    )
    status = (
        F.when(blank, "rejected").when(F.col("__exact").isNotNull(), "exact").when(F.col("__misused"), "issue_type")
        .when(F.col("__known").isNotNull(), "normalized").when(F.col("__near_c").isNotNull(), "fuzzy").otherwise("rejected" if strict else "normalized")
    )
    sure = (
        F.when(blank, 0.0).when(F.col("__exact").isNotNull(), 1.0).when(F.col("__misused"), 0.7).when(F.col("__known").isNotNull(), 0.95)
        .when(F.col("__near_c").isNotNull(), F.col("__ratio")).otherwise(0.0 if strict else 0.5)
    )
    table = known.select(F.col("__v").alias("__k"), name.alias("category_norm"), status.alias("status"), sure.alias("match_confidence"))
    return df.join(table, F.col(column).eqNullSafe(F.col("__k")), "left").drop("__k")


def normalize_category_list(df: DataFrame, key: Sequence[str], column: str = "category", **options) -> DataFrame:
    """key, categories: the distinct standard categories of a comma list, in the list's order."""
    each = df.select(*key, F.posexplode(comma_list(F.col(column))).alias("at", "__c"))
    named = normalize_category(each, "__c", **options).where("category_norm is not null")
    first = named.groupBy(*key, "category_norm").agg(F.min("at").alias("at"), F.max("match_confidence").alias("sure"))
    rows = F.sort_array(F.collect_list(F.struct("at", "category_norm", "sure")))
    done = first.groupBy(*key).agg(rows.alias("l"))
    return done.select(*key, F.transform("l", lambda x: x["category_norm"]).alias("categories"), F.transform("l", lambda x: x["sure"]).alias("confidences"))


def normalize_issue(df: DataFrame, column: str = "issue_type") -> DataFrame:
    """Append issue_norm, issue_status, issue_confidence: known spelling (0.95), squeezed (0.9), trimmed (0.95), unchanged (1)."""
    out = F.lit(None).cast("string")
    trimmed = F.trim(F.col(column))
    for variant, issue in domains.ISSUE_VARIANTS.items():
        out = F.when(F.lower(trimmed) == variant, issue).otherwise(out)
    step = df.withColumns({"__known": out, "__t": trimmed, "__s": F.regexp_replace(trimmed, r"(?U)\s+", " ")})
    blank = F.coalesce(F.col("__t"), F.lit("")) == ""
    state = lambda a, b, c, d, e: (
        F.when(blank, a).when(F.col("__known").isNotNull(), b).when(F.col("__s") != F.col("__t"), c).when(F.col("__t") != F.col(column), d).otherwise(e)
    )
    return step.withColumns(
        {
            "issue_norm": state(F.lit(None), F.col("__known"), F.col("__s"), F.col("__t"), F.col(column)),
            "issue_status": state(F.lit("rejected"), F.lit("normalized"), F.lit("normalized"), F.lit("normalized"), F.lit("exact")),
            "issue_confidence": state(F.lit(0.0), F.lit(0.95), F.lit(0.9), F.lit(0.95), F.lit(1.0)),
        }
    ).drop("__known", "__t", "__s")


def duplicate_spellings(df: DataFrame, column: str = "issue_type") -> DataFrame:
    """Canonical issues with more than one spelling: spellings, their number and rows."""
    named = normalize_issue(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column)
    out = named.groupBy("issue_norm").agg(F.sort_array(F.collect_set(column)).alias("spellings"), F.sum("n").alias("rows"))
    return out.where(F.size("spellings") > 1).withColumn("n_spellings", F.size("spellings"))


def issue_variations(df: DataFrame, column: str = "issue_type", ratio: float = 0.92) -> DataFrame:
    """Pairs a < b of distinct issues that are equal but for case, but for full stops and commas, or whose lower-cased sequence ratio is above `ratio`."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    names = df.select(F.col(column).alias("a")).distinct().where("a is not null").withColumn("low_a", F.lower("a"))
    names = names.withColumns({"case_a": bare(F.col("low_a")), "plain_a": bare(F.translate("low_a", ".,", ""))})
    other = names.select(*[F.col(f"{c}a").alias(f"{c}b") for c in ("", "low_", "case_", "plain_")])
    lows = names.select(F.col("low_a").alias("a")).distinct()
    close = close_pairs(lows, lows.withColumnRenamed("a", "b"), ratio).where(F.col("ratio") > ratio).select(F.col("a").alias("low_a"), F.col("b").alias("low_b"))
    alike = names.join(other, names["plain_a"] == other["plain_b"]).where("a < b")
    similar = names.join(close, "low_a").join(other, "low_b").where("a < b")
    how = F.when(F.col("case_a") == F.col("case_b"), "case").when(F.col("plain_a") == F.col("plain_b"), "punctuation").otherwise("similar")
    return alike.select("a", "b", how.alias("kind")).union(similar.select("a", "b", how.alias("kind"))).distinct()


def category_report(named: DataFrame, column: str = "category") -> DataFrame:
    """One row over normalize_category's output: rows, changed, misused, unknown."""
    n = F.count(F.lit(1))
    return named.agg(
        n.alias("rows"),
        F.count_if(~F.col(column).eqNullSafe(F.col("category_norm"))).alias("changed"),
        F.count_if(F.col("status") == "issue_type").alias("misused"),
        F.count_if((F.col("match_confidence") == 0.5) | (F.col("status") == "rejected")).alias("unknown"),
    )


def first_category(df: DataFrame, column: str = "category", **options) -> DataFrame:
    """Rewrite a dataset with issue_norm and only the first category of each list."""
    return normalize_category(normalize_issue(df).withColumn("__first", F.try_element_at(comma_list(F.col(column)), F.lit(1))), "__first", **options).drop("__first")


# ---- mapping


def training_edges(training: DataFrame, issue: str = "issue_type", category: str = "category", null_policy: str = "drop", standard: bool = False) -> DataFrame:
    """issue_type, category, n: the training rows behind each pair of an issue and one category of its list.

    null_policy "literal" keeps nulls as the text 'nan', "drop" leaves them out; with standard
    the categories are normalised.
    """
    rows = training.select(F.col(issue).alias("issue_type"), F.col(category).alias("category"))
    rows = rows.fillna("nan") if null_policy == "literal" else rows.dropna()
    each = rows.select("issue_type", F.explode(comma_list(F.col("category"))).alias("category"))
    each = normalize_issue(each).select(F.col("issue_norm").alias("issue_type"), "category")
    if standard:
        each = normalize_category(each).where("category_norm is not null").select("issue_type", F.col("category_norm").alias("category"))
    return each.groupBy("issue_type", "category").agg(F.count(F.lit(1)).alias("n"))


def frequencies(training: DataFrame, issue: str = "issue_type") -> DataFrame:
    """issue_type, issue_n: training rows per issue."""
    return normalize_issue(training.select(F.col(issue).alias("issue_type"))).groupBy(F.col("issue_norm").alias("issue_type")).agg(F.count(F.lit(1)).alias("issue_n"))


def unified(training: DataFrame, explicit: DataFrame, drop_blank: bool = True) -> DataFrame:
    """issue_type, categories, origin: a list of the explicit mapping(issue_type, categories) replaces the training's wholly."""
    own = training.groupBy("issue_type").agg(F.sort_array(F.collect_set("category")).alias("trained"))
    parts = F.transform(F.split("categories", ","), lambda s: F.trim(s))
    given = explicit.select(F.trim("issue_type").alias("issue_type"), (F.filter(parts, lambda c: c != "") if drop_blank else parts).alias("given"))
    return own.join(given, "issue_type", "full").select(
        "issue_type", F.coalesce("given", "trained").alias("categories"), F.when(F.col("given").isNotNull(), "explicit").otherwise("training").alias("origin")
    )


def mapping_stats(edges: DataFrame) -> DataFrame:
    """One row: issues, average, most and least categories of an issue, issues with one and with several."""
    each = edges.groupBy("issue_type").agg(F.count_distinct("category").alias("k"))
    return each.agg(
        F.count(F.lit(1)).alias("issues"),
        F.bround(F.avg("k"), 4).alias("avg_categories"),
        F.max("k").alias("max_categories"),
        F.min("k").alias("min_categories"),
        F.count_if(F.col("k") == 1).alias("single"),
        F.count_if(F.col("k") > 1).alias("multiple"),
    )


#: Rows of a mapping or of counts that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def look_up(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """issues joined to edges(issue_type, category) on the raw name, else on the normalised one; the issues are read once."""
    rest = [c for c in edges.columns if c != "issue_type"]
    lists = small(edges.groupBy("issue_type").agg(F.collect_list(F.struct(*rest)).alias("__raw")))
    named = normalize_issue(issues.join(lists, "issue_type", "left"))
    second = lists.withColumnsRenamed({"issue_type": "__i", "__raw": "__norm"})
    found = named.join(second, F.col("issue_norm") == F.col("__i"), "left")
    return found.select("issue_type", *[c for c in issues.columns if c != "issue_type"], F.inline(F.coalesce("__raw", "__norm")))


def map_issues(issues: DataFrame, edges: DataFrame, issue_n: DataFrame, category_n: DataFrame, key: str = "doc_id", use_unified: bool = False) -> DataFrame:
    """key, category, confidence, issue_types, n_sources, evidence from issues(key, issue_type, confidence, evidence).

    A category's confidence is the largest product of an issue's and the mapping's; evidence
    is joined in order of confidence, then issue.
    """
    dealt = issues.repartition(key)  # before issues multiply by their categories
    seen = look_up(dealt, edges.select("issue_type", "category")).join(small(issue_n), "issue_type", "left").join(small(category_n), "category", "left")
    scored = seen.withColumn("score", F.col("confidence") * values.mapping_confidence(F.col("issue_n"), F.col("category_n"), use_unified))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "issue_type", "evidence")))
    grouped = scored.groupBy(key, "category").agg(
        F.max("score").alias("confidence"), F.sort_array(F.collect_set("issue_type")).alias("issue_types"), F.count(F.lit(1)).alias("n_sources"), ordered.alias("__s")
    )
    said = F.array_distinct(F.filter(F.transform("__s", lambda x: x["evidence"]), lambda e: e.isNotNull() & (e != "")))
    return grouped.withColumn("evidence", F.array_join(said, "; ")).drop("__s")


def reverse_map(edges: DataFrame) -> DataFrame:
    """category, issues, n_issues."""
    return edges.groupBy("category").agg(F.sort_array(F.collect_set("issue_type")).alias("issues"), F.count_distinct("issue_type").alias("n_issues"))


def positional_ids(edges: DataFrame) -> DataFrame:
    """issue_id, issue_type, category_id, category: ids by rank of name.

    Names are dictionary entries; a rank over them is a window in one task, bounded by the
    dictionary and not by the data.
    """
    number = lambda c, p: edges.select(c).distinct().withColumn(f"{p}_id", F.concat(F.lit(f"{p}_"), F.row_number().over(Window.orderBy(c))))
    return edges.select("issue_type", "category").distinct().join(number("issue_type", "issue_type"), "issue_type").join(number("category", "category"), "category")


def pair_strength(edges: DataFrame) -> DataFrame:
    """issue_type, category, n, strength (share of the issue's rows, 3 digits)."""
    total = F.sum("n").over(Window.partitionBy("issue_type"))
    return edges.withColumn("strength", F.bround(F.col("n") / total, 3))


def export_confidence(edges: DataFrame) -> DataFrame:
    """issue_type, issue_n, confidence: rows against one hundredth of all, at most 1."""
    each = edges.groupBy("issue_type").agg(F.sum("n").alias("issue_n"))
    total = edges.agg(F.sum("n").alias("total"))
    joined = each.join(F.broadcast(total))  # one row
    return joined.select("issue_type", "issue_n", F.bround(F.least(F.col("issue_n") / F.greatest(F.col("total") * 0.01, F.lit(1.0)), F.lit(1.0)), 3).alias("confidence"))


def distribution(edges: DataFrame, top: int = 20) -> DataFrame:
    """The `top` categories by rows with their share in percent."""
    each = edges.groupBy("category").agg(F.sum("n").alias("n"))
    total = edges.agg(F.sum("n").alias("total"))
    share = each.join(F.broadcast(total)).select("category", "n", F.bround(100 * F.col("n") / F.col("total"), 1).alias("percent"))
    return share.orderBy(F.desc("n"), "category").limit(top)


# ---- sufficiency


def sufficiency(counts: DataFrame, count: str = "n") -> DataFrame:
    return counts.withColumns({"level": values.level(F.col(count)), "multiplier": values.level_multiplier(F.col(count))})


def sufficiency_report(counts: DataFrame, count: str = "n") -> DataFrame:
    """One row: labels, mean, least and most samples, critical and warning share in percent."""
    n, level = F.count(F.lit(1)), values.level(F.col(count))
    share = lambda name: F.bround(100 * F.count_if(level == name) / n, 2).alias(f"{name}_percent")
    return counts.agg(n.alias("labels"), F.bround(F.avg(count), 4).alias("mean"), F.min(count).alias("least"), F.max(count).alias("most"), share("critical"), share("warning"))


def priority_items(counts: DataFrame, label: str, count: str = "n", top: int = 10, goal: int = 20) -> DataFrame:
    """The labels with fewest samples and how many each needs."""
    return counts.select(label, count, F.greatest(F.lit(goal) - F.col(count), F.lit(0)).alias("needed")).orderBy(count, label).limit(top)


def adjust(results: DataFrame, counts: DataFrame, label: str, count: str = "n") -> DataFrame:
    """Scale confidence by the label's level, keep the original, and warn on the two lowest levels."""
    joined = results.join(counts.select(label, F.col(count).alias("training_samples")), label, "left").fillna({"training_samples": 0})
    level = values.level(F.col("training_samples"))
    return joined.withColumns(
        {"original_confidence": F.col("confidence"), "confidence": F.col("confidence") * values.level_multiplier(F.col("training_samples")), "data_sufficiency": level, "warning": level.isin("critical", "warning")}
    )


# ---- validation


def validate(df: DataFrame, allowed: DataFrame, column: str, cutoff: float = 0.7, fuzzy: bool = True) -> DataFrame:
    """Append valid, validity (valid, case, corrected, rejected), match_confidence against allowed(column).

    Exact, then case-insensitive (0.95, the smallest name of equals), then the closest name
    from `cutoff` on (the larger of equally close ones); the last only for the distinct values that the others leave.
    """
    names = allowed.select(F.col(column).alias("__name")).distinct()
    cased = names.groupBy(F.lower("__name").alias("__low")).agg(F.min("__name").alias("__cased"))
    distinct = df.select(F.trim(column).alias("__v")).distinct()
    step = distinct.join(names, F.col("__v") == F.col("__name"), "left").join(cased, F.lower("__v") == F.col("__low"), "left")
    if fuzzy:
        rest = step.where("__name is null and __cased is null and __v is not null")
        pairs = close_pairs(rest.select(F.col("__v").alias("a")), names.select(F.col("__name").alias("b")).where("b is not null"), cutoff)
        pairs = pairs.select(F.col("a").alias("__v"), F.col("b").alias("__other"), F.col("ratio").alias("__r"))
        best = pairs.groupBy("__v").agg(F.max(F.struct("__r", "__other")).alias("__best"))
        step = step.join(best, "__v", "left")
    else:
        step = step.withColumn("__best", F.lit(None).cast("struct<__r:double,__other:string>"))
    table = step.select(
        F.col("__v").alias("__k"),
        F.coalesce("__name", "__cased", "__best.__other").alias("valid"),
        F.when(F.col("__name").isNotNull(), "valid").when(F.col("__cased").isNotNull(), "case").when(F.col("__best").isNotNull(), "corrected").otherwise("rejected").alias("validity"),
        F.when(F.col("__name").isNotNull(), 1.0).when(F.col("__cased").isNotNull(), 0.95).otherwise(F.coalesce("__best.__r", F.lit(0.0))).alias("match_confidence"),
    )
    return df.join(table, F.trim(column).eqNullSafe(F.col("__k")), "left").drop("__k")


def validation_report(validated: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, hallucinations, corrections, rejections, validation_status (rejected_items, corrected or clean)."""
    n = lambda v: F.count_if(F.col("validity") == v)
    out = validated.groupBy(key).agg(n("corrected").alias("corrections"), n("rejected").alias("rejections"))
    status = F.when(F.col("rejections") > 0, "rejected_items").when(F.col("corrections") > 0, "corrected").otherwise("clean")
    return out.withColumns({"hallucinations": F.col("corrections") + F.col("rejections") > 0, "validation_status": status})


def look_up_service(df: DataFrame, mapping: DataFrame, column: str = "issue_type", cutoff: float = 0.7) -> DataFrame:
    """Append category, lookup_confidence: case-insensitive name (1), closest name from `cutoff` on (its ratio), else Others at 0.1."""
    known = mapping.select(F.col("issue_type").alias("__issue"), F.col("category").alias("category"))
    found = validate(df, mapping.select(F.col("issue_type").alias(column)), column, cutoff)
    joined = found.join(known, F.col("valid") == F.col("__issue"), "left")
    sure = F.when(F.col("validity").isin("valid", "case"), 1.0).when(F.col("validity") == "corrected", F.col("match_confidence")).otherwise(0.1)
    return joined.withColumns({"category": F.coalesce("category", F.lit("Others")), "lookup_confidence": sure}).drop("__issue", "valid", "validity", "match_confidence")


# ---- governance


def grouped_categories(edges: DataFrame) -> DataFrame:
    return edges.groupBy("issue_type").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def mapping_diff(current: DataFrame, new: DataFrame) -> DataFrame:
    """issue_type, state (SAME, DIFFERENT, NEW, ONLY_IN_CURRENT), added, removed from two tables of edges."""
    a = grouped_categories(current).withColumnRenamed("categories", "old")
    b = grouped_categories(new).withColumnRenamed("categories", "new")
    both = a.join(b, "issue_type", "full")
    state = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "ONLY_IN_CURRENT").when(F.col("old") == F.col("new"), "SAME").otherwise("DIFFERENT")
    none = F.array().cast("array<string>")
    old, fresh = F.coalesce("old", none), F.coalesce("new", none)
    return both.select("issue_type", state.alias("state"), F.array_except(fresh, old).alias("added"), F.array_except(old, fresh).alias("removed"))


def mapping_merge(current: DataFrame, new: DataFrame) -> DataFrame:
    """issue_type, categories: the union per issue."""
    return grouped_categories(current.select("issue_type", "category").union(new.select("issue_type", "category")))


def usage_compare(current: DataFrame, new: DataFrame) -> DataFrame:
    """category, n_current, n_new, difference."""
    count = lambda d, n: d.groupBy("category").agg(F.count_distinct("issue_type").alias(n))
    both = count(current, "n_current").join(count(new, "n_new"), "category", "full").fillna(0)
    return both.withColumn("difference", F.col("n_new") - F.col("n_current"))


def coverage(truth: DataFrame, mapped: DataFrame) -> DataFrame:
    """file_name, issues, covered, missing, coverage in percent from truth(file_name, issue_type)."""
    known = mapped.select("issue_type").distinct().withColumn("__in", F.lit(True))
    pairs = truth.select("file_name", "issue_type").distinct().join(known, "issue_type", "left")
    out = pairs.groupBy("file_name").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("__in")).alias("covered"))
    return out.withColumns({"missing": F.col("issues") - F.col("covered"), "coverage": F.bround(100 * F.col("covered") / F.col("issues"), 2)})


def missing_issues(truth: DataFrame, mapped: DataFrame) -> DataFrame:
    """issue_type, files, file_names of truth's issues that the mapping lacks."""
    gone = truth.join(mapped.select("issue_type").distinct(), "issue_type", "left_anti")
    return gone.groupBy("issue_type").agg(F.count_distinct("file_name").alias("files"), F.sort_array(F.collect_set("file_name")).alias("file_names"))


def add_mapping(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return edges.select("issue_type", "category").union(rows.select("issue_type", "category")).distinct()


def remove_mapping(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return edges.join(rows.select("issue_type").distinct(), "issue_type", "left_anti")


def top_categories(truth: DataFrame, top: int = 5) -> DataFrame:
    """file_name, categories: the most frequent as 'name(count)', joined."""
    counted = truth.groupBy("file_name", "category").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("file_name").orderBy(F.desc("n"), "category"))
    best = counted.withColumn("r", rank).where(F.col("r") <= top)
    rows = F.sort_array(F.collect_list(F.struct("r", F.concat("category", F.lit("("), "n", F.lit(")")).alias("c"))))
    return best.groupBy("file_name").agg(F.array_join(F.transform(rows, lambda x: x["c"]), ", ").alias("categories"))


def mode_category(training: DataFrame) -> DataFrame:
    """issue_type, category: the most frequent, the smallest of equals."""
    return training.groupBy("issue_type").agg(F.mode("category", True).alias("category"))


def stratified_split(df: DataFrame, label: str, key: Sequence[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Append is_validation: per label max(1, int(n * share)) rows, in an order that the md5 of key and seed gives."""
    order = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))
    by = Window.partitionBy(label)
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(by) * F.lit(share)))
    return df.withColumn("is_validation", F.row_number().over(by.orderBy(order, *key)) <= n)


def template_samples(spark: SparkSession, issues: DataFrame, templates: Sequence[str], per_issue: int, seed: int = 42) -> DataFrame:
    """issue_type, sample, body: per_issue texts per issue, each of a template that a hash chooses, {issue} filled in."""
    choice = F.array(*[F.lit(t) for t in templates])
    each = issues.select("issue_type").distinct().withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(per_issue))))
    pick = F.pmod(F.xxhash64("issue_type", "sample", F.lit(seed)), F.lit(len(templates))).cast("int")
    return each.withColumn("body", F.replace(F.get(choice, pick), F.lit("{issue}"), F.col("issue_type")))


def normalize_columns(df: DataFrame, **options) -> DataFrame:
    """Every column whose name has 'category': normalised, the given values kept under <name>_Original."""
    for c in [c for c in df.columns if "category" in c.lower()]:
        renamed = df.withColumnRenamed(c, f"{c}_Original")
        df = normalize_category(renamed, f"{c}_Original", **options).withColumnRenamed("category_norm", c).drop("status", "match_confidence")
    return df


def changed(a: Column, b: Column) -> Column:
    """Whether two category lists differ as sets."""
    return F.sort_array(F.array_distinct(a)) != F.sort_array(F.array_distinct(b))
