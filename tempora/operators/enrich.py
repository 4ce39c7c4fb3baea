"""Events improved field by field from a model's answers, and the sample of events that a judge looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["session", "seq"]
#: The rule by which an answer's field reaches an event.
RULES = {"frame_description": "set", "description": "weak", "interaction_target": "missing", "page_title": "missing", "page_location": "missing"}
#: A description of fewer characters than this, white space at its ends aside, is weak.
LEAST_CHARS = 15
#: What a judge may say of a part of an event, and the parts.
RATINGS = ("correct", "partially_correct", "incorrect", "unverifiable")
ASPECTS = ("type", "description", "timing", "target", "overall")


def present(text: Column) -> Column:
    """Whether there is any text: neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def weak(text: Column) -> Column:
    """Whether a description is missing or too short to say anything."""
    bare = F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")
    return F.coalesce(F.length(bare) < LEAST_CHARS, F.lit(True))


def needs(events: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """events with needs_<field> for each rule, and needs_any: whether a field that is always set has no text yet. A column that
    events do not have is missing in all of them."""
    text = {c: F.col(c) if c in events.columns else F.lit(None).cast("string") for c in rules}
    lacking = {f"needs_{c}": weak(text[c]) if rule == "weak" else ~present(text[c]) for c, rule in rules.items()}
    always = [~present(text[c]) for c, rule in rules.items() if rule == "set"]
    any_ = always[0] if always else F.lit(False)
    for c in always[1:]:
        any_ = any_ | c
    return events.withColumns(lacking | {"needs_any": any_})


def needs_summary(events: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """A row per session: events, how many need an answer, which fields they lack, and the needy ones by type as a map."""
    n = needs(events, rules)
    lacks = F.col("needs_any")
    each = n.groupBy("session", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(lacks).alias("open"), *(F.count_if(lacks & F.col(f"needs_{c}")).alias(c) for c in rules))
    by_type = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("open") > 0, F.struct("type", "open")))))  # a row for each type
    return each.groupBy("session").agg(F.sum("n").alias("events"), F.sum("open").alias("needy"), *(F.sum(c).alias(c) for c in rules), by_type.alias("by_type"))


def merged_fields(events: DataFrame, answers: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """events with the fields of their answers (session, seq, place and fields) merged in; applying it again changes nothing.

    set: an answer's text replaces whatever is there. missing: it fills only what has no text. weak: it replaces a weak
    description where it is not weak itself. Empty texts of an answer never count. Where an event has several answers, the
    last one by place with text counts, field by field. Events without an answer, and all other columns, stay as they are.
    """
    fields = [c for c in rules if c in answers.columns]
    usable = {c: F.when(~weak(F.col(c)) if rules[c] == "weak" else present(F.col(c)), F.col(c)) for c in fields}
    last = answers.groupBy(*KEY).agg(*(F.max_by(usable[c], F.when(usable[c].isNotNull(), F.col("place"))).alias(f"_new_{c}") for c in fields))
    both = events.join(last, KEY, "left")

    def ruled(c: str) -> Column:
        old, new = F.col(c) if c in events.columns else F.lit(None).cast("string"), F.col(f"_new_{c}")
        open_ = {"set": F.lit(True), "missing": ~present(old), "weak": weak(old)}[rules[c]]
        return F.when(open_ & new.isNotNull(), new).otherwise(old)

    return both.withColumns({c: ruled(c) for c in fields}).drop(*(f"_new_{c}" for c in fields))


def validation_sample(events: DataFrame, most: Column, strategy: str = "all", fill: str = "remainder", seed: int = 0) -> DataFrame:
    """The events (session, seq, type, confidence) of each session that a judge sees, `most` at most (0 or less: all).

    low_confidence: the least sure ones, a missing confidence first. stratified, and all where there are more than `most`: by
    type, in proportion. Each type gets the whole part of most * n / total, exactly; the seats left go to the types with the
    largest remainders (ties by name), or with fill="confidence" to the least sure events left. Within a type a seeded hash
    of the event decides, so the same events come every time.
    """
    if strategy not in ("all", "low_confidence", "stratified") or fill not in ("remainder", "confidence"):
        raise ValueError(f"no such sample: {strategy}, {fill}")
    sure = F.coalesce("confidence", F.lit(-1.0))
    rows = events.withColumn("_most", most.cast("long"))
    types = rows.groupBy("session", "type").agg(F.count(F.lit(1)).alias("_n"), F.max("_most").alias("_most"))
    w, all_ = W.partitionBy("session"), F.col("_all")
    types = types.withColumn("_all", F.sum("_n").over(w)).withColumn("_seats", F.when((F.col("_most") <= 0) | (F.col("_most") >= all_), all_).otherwise(F.col("_most")))
    whole = F.floor(F.col("_seats").cast("decimal(19,0)") * F.col("_n") / all_).cast("long")
    types = types.withColumn("_whole", whole).withColumn("_rest", F.col("_seats") * F.col("_n") - F.col("_whole") * all_)
    spare = F.col("_seats") - F.sum("_whole").over(w)
    place = F.row_number().over(w.orderBy(F.desc("_rest"), "type"))
    types = types.withColumn("_spare", spare).withColumn("_share", F.col("_whole") + F.when((place <= spare) & F.lit(fill == "remainder"), 1).otherwise(0))
    known = types.select("session", "type", "_seats", "_spare", "_share")
    in_order = rows.drop("_most").join(known, ["session", "type"])
    least = [sure.asc(), F.col("seq").asc()]
    if strategy == "low_confidence":
        kept = in_order.withColumn("_k", F.row_number().over(w.orderBy(*least))).filter(F.col("_k") <= F.col("_seats"))
    else:
        by_hash = W.partitionBy("session", "type").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "session", "seq")), "seq")
        ranked = in_order.withColumn("_in", F.row_number().over(by_hash) <= F.col("_share"))
        rest = F.row_number().over(W.partitionBy("session", "_in").orderBy(*least))
        kept = ranked.withColumn("_k", rest).filter(F.col("_in") | (F.lit(fill == "confidence") & (F.col("_k") <= F.col("_spare"))))
    return kept.select(*events.columns)


def verdicts(judged: DataFrame, by: list[str]) -> DataFrame:
    """Verdicts (<aspect>_verdict) rolled up: events, for each aspect the count of every rating and its accuracy, the share of
    `correct` among those that could be verified (null where none could). An unknown or missing rating counts as unverifiable."""
    columns = []
    for a in ASPECTS:
        said = F.when(F.col(f"{a}_verdict").isin(*RATINGS), F.col(f"{a}_verdict")).otherwise(RATINGS[-1])
        columns += [F.count_if(said == r).alias(f"{a}_{r}") for r in RATINGS]
        columns.append(F.try_divide(F.count_if(said == RATINGS[0]), F.count_if(said != RATINGS[-1])).alias(f"{a}_accuracy"))
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), *columns)
