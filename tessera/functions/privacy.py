"""Redaction and leak scans as chains of built-in regular expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.functions.text import normalized

# Labels, patterns, placeholders and their order have to be these for equal results.
SECRET_LABEL = r"(?:密码|口令|验证码|校验码|verification[ _-]?code|one[ _-]?time[ _-]?password|password|passcode|passwd|otp|pin|token|access[ _-]?key|secret|api[ _-]?key|private[ _-]?key)"
PATTERNS = {
    "secret": rf"(?is)(?<![A-Za-z0-9_]){SECRET_LABEL}(?![A-Za-z0-9_])[ \t]*[:：=]?[ \t]*[A-Za-z0-9_+/=.-]{{4,}}",
    "email": r"(?iU)(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?![\w.-])",
    "phone": r"(?U)(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)",
    "idcard": r"(?U)(?<!\d)\d{17}[0-9Xx](?!\d)",
    "bank": r"(?U)(?<!\d)\d{16,19}(?!\d)",
    "coordinate": r"(?U)(?<![\d.])[-+]?\d{1,3}\.\d{4,}\s*[,， ]\s*[-+]?\d{1,3}\.\d{4,}(?![\d.])",
    "ipv4": r"(?U)(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.])",
    "address": r"(?i)(?:地址|住址)\s*[:：]\s*[^\n，。；;]{2,40}|(?:定位|位置)\s*[:：]\s*(?:[^\n，。；;]{2,40})",
    "wxid": r"(?U)\bwxid_[A-Za-z0-9_-]+\b",
    "mention": r"(?U)(?<![\w.+-])@[\w一-鿿·-]{1,30}",
    "url": r"(?iU)https?://[^\s<>]+",
}
STEPS = (
    ("secret", "credential", "<SECRET>"),
    ("email", "contact", "<PII_CONTACT>"),
    ("phone", "contact", "<PII_CONTACT>"),
    ("idcard", "identity", "<PII_ID>"),
    ("bank", "payment_identifier", "<PII_PAYMENT>"),
    ("coordinate", "precise_location", "<PRIVATE_LOCATION>"),
    ("ipv4", "network_identifier", "<PRIVATE_ID>"),
    ("address", "precise_location", "<PRIVATE_LOCATION>"),
    ("wxid", "identifier", "<PRIVATE_ID>"),
    ("mention", "third_party", "<PRIVATE_PERSON>"),
)
# End of fixed values.


#: What a text, in lower case, has to hold for a pattern to match: one of some strings, or a shorter pattern. Both cost less than the pattern.
_HINTS = {
    "secret": ("pass", "otp", "pin", "token", "key", "secret", "code", "密码", "口令", "验证码", "校验码"),
    "address": ("地址", "住址", "定位", "位置"),
    "email": ("@",),
    "mention": ("@",),
    "url": ("http",),
    "wxid": ("wxid_",),
}
_SHORT = {"phone": r"(?U)\d{11}", "idcard": r"(?U)\d{17}", "bank": r"(?U)\d{16}", "ipv4": r"(?U)\d\.\d", "coordinate": r"(?U)\d\.\d{4}"}
#: The same matches, where a look at one character spares the alternatives at most places.
_FAST = PATTERNS | {"secret": PATTERNS["secret"].replace("(?is)", "(?is)(?=[vopats密口验校])", 1)}


def _may(name: str, value: Column, low: Column) -> Column:
    """Whether a pattern can match in a text, given also in lower case."""
    return value.rlike(_SHORT[name]) if name in _SHORT else functools.reduce(operator.or_, (F.contains(low, F.lit(h)) for h in _HINTS[name]))


def with_redaction(df: DataFrame, text: str, entities: dict[str, str] | None = None) -> DataFrame:
    """``df`` plus redacted and categories (sorted), from the normalised text. Each step sees what the steps before it left; links keep their host; entities go longest first.

    What a step puts in holds no digit and nothing of ``_HINTS`` of a later step, so the text before all steps tells which patterns can match.
    """
    names = [*(name for name, _, _ in STEPS), "url"]
    out, hits = df.withColumn("__v", normalized(text)).withColumn("__low", F.lower("__v")), []
    out = out.withColumns({f"__m_{n}": _may(n, F.col("__v"), F.col("__low")) for n in names}).drop("__low")
    for k, (name, category, put) in enumerate(STEPS):
        hit = F.col(f"__m_{name}") & F.col("__v").rlike(_FAST[name])
        out = out.withColumn(f"__h{k}", F.when(hit, F.lit(category)))
        out = out.withColumn("__v", F.when(F.col(f"__h{k}").isNotNull(), F.regexp_replace("__v", _FAST[name], put)).otherwise(F.col("__v")))
        hits.append(f"__h{k}")
    out = out.withColumn("__url", F.when(F.col("__m_url") & F.col("__v").rlike(PATTERNS["url"]), F.lit("link_identifier")))
    hosts = F.regexp_replace("__v", r"(?iU)https?://(?:[^\s<>/?#@]*@)?([^\s<>/?#:@]+)[^\s<>]*", "<LINK:$1>")
    out = out.withColumn("__v", F.when(F.col("__url").isNotNull(), F.regexp_replace(hosts, PATTERNS["url"], "<LINK>")).otherwise(F.col("__v")))
    value, hits = F.col("__v"), [*hits, "__url"]
    for entity, put in sorted((entities or {}).items(), key=lambda x: -len(x[0])):
        value = F.replace(value, F.lit(entity), F.lit(put))
    if entities:
        out = out.withColumn("__ent", F.lit("custom_entity"))
        hits.append("__ent")
    return out.withColumns({"redacted": value, "categories": F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))}).drop("__v", *hits, *(f"__m_{n}" for n in names))


def scan(text: Column | str) -> dict[str, Column]:
    """Counts by category and hard_leak_count, their sum, of a text that is normalised already (``scanned``); identity numbers aren't counted as bank numbers again."""
    value = F.coalesce(col(text), F.lit(""))
    low = F.lower(value)

    def count(name: str, pattern: str) -> Column:
        n = F.regexp_count(F.regexp_replace(value, PATTERNS["idcard"], " ") if name == "bank" else value, F.lit(pattern))
        return F.when(_may(name, value, low), n).otherwise(F.lit(0))

    counts = {f"raw_{n}_matches": count(n, p) for n, p in PATTERNS.items()}
    return counts | {"hard_leak_count": sum(counts.values(), F.lit(0))}


def scanned(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus the counts of ``scan`` over the normalised text, which is made once."""
    counts = scan("__normal")
    keep = [F.col(f"`{c}`") for c in df.columns]
    ready = df.withColumn("__normal", normalized(text))
    named = ready.select(*keep, *[c.alias(n) for n, c in counts.items() if n != "hard_leak_count"])
    return named.withColumn("hard_leak_count", sum((F.col(n) for n in counts if n != "hard_leak_count"), F.lit(0)))


def secret_value(before: Column, now: Column) -> Column:
    """The compact value, if the message before is but a label of a secret and this one the value; else null."""
    label, value = F.trim(before), F.btrim(F.trim(now), F.lit("`'\"“”‘’，。；;:：,!?！？()[]{}"))
    short = F.length(label) <= 8
    role = F.lower(value).isin("self", "target", "user", "assistant", "system")
    code = label.rlike("(?:验证码|校验码)$") & short & value.rlike("^[0-9]{4,12}$")
    word = label.rlike("(?:密码|口令)$") & short & value.rlike("^[A-Za-z0-9_+/=.-]{4,}$") & ~role
    other = label.rlike(rf"(?i)^{SECRET_LABEL}$") & ~label.rlike("^(?:密码|口令|验证码|校验码)$") & value.rlike("^[A-Za-z0-9_+/=]{4,}$") & ~role
    given = ~before.rlike(PATTERNS["secret"])
    return F.when(F.coalesce(given & (code | word | other), F.lit(False)), value)


def adjacent_redacted(messages: Column) -> Column:
    """Messages (structs of idx and content, in order) with values after a label of a secret replaced by ``<SECRET>``.

    Only messages with following indices are adjacent; the one before counts as it stands after its own replacement.
    """
    nothing = F.filter(messages, lambda _: F.lit(False))

    def step(done: Column, m: Column) -> Column:
        last = F.element_at(done, -1)
        value = F.when((F.size(done) > 0) & (m["idx"] == last["idx"] + 1), secret_value(last["content"], m["content"]))
        # the value stands in the message just once as a stretch, so the first place is the place
        put = F.when(value.isNull(), m["content"]).otherwise(F.concat(F.split_part(m["content"], value, F.lit(1)), F.lit("<SECRET>"), F.substr(m["content"], F.position(value, m["content"]) + F.length(value))))
        return F.array_append(done, F.struct(m["idx"].alias("idx"), put.alias("content")))

    return F.aggregate(messages, nothing, lambda done, m: F.when(F.size(done) == 0, F.array_append(done, m)).otherwise(step(done, m)))


def adjacent_count(messages: Column) -> Column:
    """How many adjacent pairs of the messages as they are make a credential."""
    pairs = F.transform(messages, lambda m, i: F.named_struct(F.lit("a"), m, F.lit("b"), F.get(messages, i + 1)))
    hit = lambda p: p["b"].isNotNull() & (p["b"]["idx"] == p["a"]["idx"] + 1) & secret_value(p["a"]["content"], p["b"]["content"]).isNotNull()
    return F.size(F.filter(pairs, lambda p: F.coalesce(hit(p), F.lit(False))))


def split_credentials(df: DataFrame, owner: str, index: str, text: str) -> DataFrame:
    """``df`` plus split_secret: the message before is but a label of a secret, and this one, next in the source, a compact value."""
    w = Window.partitionBy(owner).orderBy(index)
    adjacent = F.col(index) == F.lag(index).over(w) + 1
    return df.withColumn("split_secret", F.coalesce(adjacent & secret_value(F.lag(text).over(w), F.col(text)).isNotNull(), F.lit(False)))


def injection_guard(text: Column | str, markers: tuple[str, ...], targets: tuple[str, ...]) -> Column:
    """Whether a marker of each list occurs."""
    low = F.lower(col(text))
    hit = lambda words: F.greatest(*[low.contains(w.lower()) for w in words], F.lit(False))
    return hit(markers) & hit(targets)
