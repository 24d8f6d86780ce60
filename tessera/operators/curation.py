"""Usefulness curation of (user, assistant) samples: observations, train-only thresholds, decisions, caps, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import digest, share, upper_index
from tessera.functions.text import last_match, meaningful, regexp_all, tags, template

# Categories, weights and signal words have to be these for equal decisions.
CATEGORIES = {
    "emotional_attunement": "辛苦|委屈|心疼|难过|不开心|别难受|理解你|懂你|没关系",
    "caring_followup": "还好吗|怎么了|要不要|有没有|吃饭|休息|早点睡|睡了吗|身体|舒服吗|到家了吗|忙完了吗",
    "affectionate": "宝贝|宝宝|亲爱的|老公|老婆|想你|爱你|抱抱|亲亲|陪你",
    "life_advice": "建议|可以先|不如|要不|试试|记得|别忘|先.{0,8}再|慢慢来",
    "joint_decision": "我们一起|一起去|一起看|一起想|商量|你决定|听你的|都可以|要不然",
    "playful": "哈哈|嘿嘿|嘻嘻|笑死|逗你|笨蛋|调皮|哼哼",
    "comfort_support": "别怕|放心|没事的|我在|陪着你|支持你|慢慢来|会好的|加油|抱抱",
    "warm_tone": "[呀啦呢哦嘛哇诶～~]|好哒|嗯嗯|乖|晚安|早安",
    "engaged_question": "[?？]",
}
LIGHT = {"warm_tone": 1}
PLACEHOLDER = r"(?i)(?:<\s*(?:image|video|audio|file|emoji|sticker|media)[^>]*>|\[\s*(?:图片|视频|语音|文件|表情|动画表情|image|video|audio|file|emoji|sticker|media)\s*\])"
NUMBER_FACT = r"(?i)(?:\d{1,4}[-/.]\d{1,2}(?:[-/.]\d{1,2})?|\d+(?:\.\d+)?(?:年|月|日|点|分|元|块|公里|kg|GB|MB))"
WORK = "工作|项目|会议|客户|同事|领导|需求|代码|文档|方案|进度|业务|公司|加班|汇报|任务"
THIRD_PARTY = "八卦|听说|她说|他说|前任|小三|出轨|谁和谁|同事说|朋友说"
PRIORITY = ("invalid_direct_context", "missing_user_context", "context_length_outlier", "target_length_outlier", "empty_or_emoji_only_target", "assistant_reply_too_short", "structured_memory_candidate_not_style_sft", "repetitive_template_cap", "long_work_log", "third_party_gossip", "insufficient_usefulness_score", "no_target_style_signal")
# End of fixed values.


@dataclass(frozen=True)
class Policy:
    least_chars: int = 3
    least_score: int = 5
    many_messages: int = 6
    template_least: int = 6
    template_longest: int = 32
    cap: int = 3
    quantile: float = 0.99


def observe(df: DataFrame, user: str = "user_text", assistant: str = "assistant_text") -> DataFrame:
    """``df`` plus the counts, flags and categories that decisions need; one projection."""
    u, a = F.coalesce(user, F.lit("")), F.coalesce(assistant, F.lit(""))
    both, body = F.concat_ws("\n", u, a), meaningful(F.regexp_replace(a, PLACEHOLDER, ""))
    return df.withColumns(
        {
            "user_chars": F.length(u),
            "assistant_chars": F.length(a),
            "assistant_meaningful": F.length(body),
            "template": digest(template(a)),
            "template_chars": F.length(template(a)),
            "categories": tags(a, CATEGORIES),
            "work_signals": F.size(regexp_all(both, WORK)),
            "fact_signals": F.size(regexp_all(both, NUMBER_FACT)),
            "gossip": both.rlike(THIRD_PARTY),
            "hard_flags": F.array_compact(
                F.array(
                    F.when(F.lower(last_match(u, r"(?mi)^(self|target)\s*[:：]")) == "target", F.lit("invalid_direct_context")),
                    F.when(meaningful(u) == "", F.lit("missing_user_context")),
                    F.when(body == "", F.lit("empty_or_emoji_only_target")),
                )
            ),
        }
    )


def quantile_value(df: DataFrame, c: str, q: float, name: str) -> DataFrame:
    """One row with the value at index ceil((n - 1) * q) in sorted order; counts of values are summed before they are ordered."""
    per_value = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    upto = per_value.withColumn("__to", F.sum("__n").over(Window.orderBy("__v"))).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    return upto.where(F.col("__to") > upper_index(F.col("__all"), q)).agg(F.min("__v").alias(name))


def thresholds(train: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row, from training rows alone: user_long, assistant_long."""
    return quantile_value(train, "user_chars", policy.quantile, "user_long").crossJoin(quantile_value(train, "assistant_chars", policy.quantile, "assistant_long"))


def decide(observed: DataFrame, limits: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``observed`` plus score, reasons (sorted) and selected (no reason). ``limits`` is the one row of ``thresholds``."""
    d = observed.crossJoin(F.broadcast(limits))
    cats = F.col("categories")
    weight = F.aggregate(cats, F.lit(0), lambda s, c: s + F.when(c.isin(*LIGHT), 1).otherwise(2))
    work = (F.col("user_chars") > F.col("user_long")) & (F.col("work_signals") >= 3)
    score = F.lit(2) + F.when(F.col("assistant_chars") <= F.col("assistant_long"), 1).otherwise(-1) + F.when(F.col("context_messages") >= policy.many_messages, 1).otherwise(0) + weight - F.when(work, 3).otherwise(0) - F.when(F.col("gossip"), 2).otherwise(0)
    d = d.withColumns({"score": score.cast("int"), "__work": work})
    low = F.col("score") < policy.least_score
    styled = F.size(F.array_except(cats, F.array(F.lit("engaged_question"), F.lit("warm_tone")))) > 0

    def reason(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    found = F.array(
        reason(F.col("assistant_meaningful") < policy.least_chars, "assistant_reply_too_short"),
        reason(F.col("user_chars") > 2 * F.col("user_long"), "context_length_outlier"),
        reason(F.col("assistant_chars") > 4 * F.col("assistant_long"), "target_length_outlier"),
        reason((F.col("fact_signals") >= 3) & ~styled, "structured_memory_candidate_not_style_sft"),
        reason(F.size(cats) == 0, "no_target_style_signal"),
        reason(low, "insufficient_usefulness_score"),
        reason(F.col("__work") & low, "long_work_log"),
        reason(F.col("gossip") & low, "third_party_gossip"),
    )
    reasons = F.array_sort(F.concat(F.col("hard_flags"), F.array_compact(found)))
    return d.withColumn("reasons", reasons).withColumn("selected", F.size("reasons") == 0).drop("__work")


def cap_templates(decided: DataFrame, train: DataFrame, key: str, policy: Policy = Policy(), part: str = "split") -> DataFrame:
    """Of selected rows with a template that training repeats, the first ``cap`` per split and template by hash of the key stay selected."""
    often = train.where(F.col("template_chars") <= policy.template_longest).groupBy("template").agg(F.count(F.lit(1)).alias("__f")).where(F.col("__f") >= policy.template_least).select("template", F.lit(True).alias("__often"))
    order = Window.partitionBy(part, "template", "selected").orderBy(F.sha2(F.col(key).cast("string").cast("binary"), 256))
    ranked = decided.join(often, "template", "left").withColumn("__rank", F.row_number().over(order))
    over = F.col("selected") & F.coalesce("__often", F.lit(False)) & (F.col("__rank") > policy.cap)
    out = ranked.withColumns({"reasons": F.when(over, F.array(F.lit("repetitive_template_cap"))).otherwise(F.col("reasons")), "selected": F.col("selected") & ~over})
    return out.drop("__often", "__rank")


def primary_reason(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, F.lit("selected_useful_style")).otherwise(F.coalesce(*[F.when(F.array_contains(reasons, r), F.lit(r)) for r in PRIORITY], F.lit("excluded_other")))


def duplicate_summary(df: DataFrame, key: str, part: str) -> DataFrame:
    """Per part: rows, unique values, repeated groups, rows in them and their share."""
    per = df.groupBy(part, key).agg(F.count(F.lit(1)).alias("__n"))
    out = per.groupBy(part).agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("unique_values"), F.count_if(F.col("__n") > 1).alias("repeated_groups"), F.sum(F.when(F.col("__n") > 1, F.col("__n")).otherwise(0)).alias("rows_in_repeated"))
    return out.withColumn("repeated_share", F.round(share(F.col("rows_in_repeated"), F.col("rows")), 6))


def length_summary(df: DataFrame, c: str, part: str) -> DataFrame:
    """Per part: count, min, p50, p90, p99, max of a length, by index ceil((n - 1) * q)."""
    per = df.groupBy(part, F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(part)
    upto = per.withColumns({"__to": F.sum("__n").over(w.orderBy("__v")), "__all": F.sum("__n").over(w)})
    at = lambda q: F.min(F.when(F.col("__to") > upper_index(F.col("__all"), q), F.col("__v")))
    return upto.groupBy(part).agg(F.max("__all").alias("n"), F.min("__v").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("__v").alias("most"))
