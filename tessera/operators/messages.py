"""Messages in a common form: roles, kinds, times, ids and digests, as built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import first_given

# Kinds, roles, aliases and placeholders of the message form.
KINDS = {
    "text": "text", "emoji": "emoji", "image": "image", "voice": "voice", "video": "video", "file": "file", "quote": "quote", "link": "link", "system": "system",
    "payment": "payment", "transfer": "payment", "redpacket": "payment", "call": "call", "voip": "call", "chathistory": "other",
}
ROLES = ("self", "target", "other", "unknown")
ALIASES = {"me": "self", "user": "self", "assistant": "target", "friend": "target"}
PLACEHOLDERS = {"emoji": "<EMOJI>", "image": "<MEDIA_IMAGE>", "voice": "<MEDIA_VOICE>", "video": "<MEDIA_VIDEO>"}
#: Words of a topic; a text has each topic of which it holds a word.
TOPICS = {
    "work": ("工作", "上班", "下班", "公司", "开会", "汇报", "项目", "加班", "老板"),
    "study": ("学习", "考试", "作业", "上课", "论文", "复习"),
    "food": ("吃饭", "吃什么", "早饭", "午饭", "晚饭", "早餐", "午餐", "晚餐", "饿", "面条", "火锅"),
    "health": ("生病", "头疼", "头痛", "发烧", "感冒", "医院", "吃药", "肚子疼"),
    "plans": ("几点", "明天", "安排", "出发", "到家", "周末", "起床", "睡觉"),
    "support": ("难过", "紧张", "担心", "委屈", "焦虑", "害怕", "开心", "心情"),
    "relationship": ("想你", "喜欢你", "爱你", "吵架", "分手", "道歉", "对不起"),
}
#: Words that queries don't search for.
QUERY_STOPS = ("什么", "哪里", "哪个", "哪儿", "时候", "怎么", "是否", "多少", "记得", "之前", "刚才", "今天", "现在", "吗", "呢", "吧")
# End of fixed values.


def looked_up(value: Column, names: Mapping[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), default)


def role(speaker: Column, is_sent: Column, speakers: Mapping[str, str] | None = None) -> Column:
    """self, target, other or unknown: what was sent is by self, else the speaker's own map, then aliases, whatever the case."""
    named = looked_up(speaker, speakers, speaker) if speakers else speaker
    low = F.lower(F.coalesce(F.nullif(named, F.lit("")), F.lit("unknown")))
    found = looked_up(low, ALIASES, low)
    return F.when(F.coalesce(is_sent, F.lit(False)), "self").when(found.isin(*ROLES), found).otherwise("unknown")


def kind(raw: Column) -> Column:
    return looked_up(F.replace(F.lower(F.coalesce(raw, F.lit("text"))), F.lit("_"), F.lit("")), KINDS, F.lit("other"))


def iso_utc(ts: Column) -> Column:
    """A timestamp without zone, taken as UTC, in ISO form; fractions only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(rest == "000000", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit("+00:00"))


def message(df: DataFrame, id_: Column, index: Column, ts: Column, speaker: Column, is_sent: Column, kind_: Column, texts: Sequence[Column], speakers: Mapping[str, str] | None = None) -> DataFrame:
    """message_id, record_index, timestamp, role, kind, text and parse_status of each raw row; blank media get their placeholder, texts aren't redacted yet."""
    k = kind(kind_)
    text = first_given(*texts)
    media = k.isin(*PLACEHOLDERS) & (F.trim(F.coalesce(text, F.lit(""))) == "")
    return df.select(
        F.coalesce(id_, F.concat(F.lit("record_"), index)).alias("message_id"),
        index.alias("record_index"),
        iso_utc(ts).alias("timestamp"),
        role(speaker, is_sent, speakers).alias("role"),
        k.alias("kind"),
        F.nullif(F.when(media, looked_up(k, PLACEHOLDERS, F.lit(""))).otherwise(F.coalesce(text, F.lit(""))), F.lit("")).alias("text"),
        F.when(ts.isNull(), "partial").otherwise("ok").alias("parse_status"),
    )


def json_text(c: Column) -> Column:
    """A string as JSON with nothing escaped but what has to be; null as null."""
    body = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    for sign, put in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\b", r"\\b"), ("\f", r"\\f")):
        body = F.regexp_replace(body, sign if sign != "\b" else r"\x08", put)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """One JSON object: keys in order, no blanks; columns are strings, whole numbers, booleans or ready-made JSON (``json`` prefix in the key)."""
    parts = []
    for name in sorted(fields, key=lambda n: n.removeprefix("json:")):
        c = fields[name]
        parts += [F.lit(("," if parts else "{") + '"' + name.removeprefix("json:") + '":'), c if name.startswith("json:") else json_text(c)]
    return F.concat(*parts, F.lit("}"))


def number_json(c: Column) -> Column:
    """A whole number or boolean as JSON."""
    return F.coalesce(F.lower(c.cast("string")), F.lit("null"))


def list_json(items: Column, each) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, each), ","), F.lit("]"))


def canonical_digest(json: Column) -> Column:
    return F.sha2(json.cast("binary"), 256)


def text_by_role(messages: Column, wanted: str) -> Column:
    """Contents of one role's messages (structs of role, content), joined by newlines."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == wanted), lambda m: m["content"]), "\n")


def content_hash(messages: Column) -> Column:
    """SHA-256 of all contents, joined by newlines."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n").cast("binary"), 256)


def sample_key(messages: Column) -> Column:
    """SHA-256 of ``role:content`` lines."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").cast("binary"), 256)


def kept_messages(messages: Column, redact=lambda c: c) -> Column:
    """Messages of known roles with something to say, redacted and trimmed."""
    clean = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.trim(redact(F.coalesce(m["content"], F.lit("")))).alias("content")))
    return F.filter(clean, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))


def memory_id(owner: Column, content: Column, ids: Column) -> Column:
    return F.concat(F.lit("memory_"), F.substring(F.sha2(F.concat_ws("\x1f", owner, content, F.array_join(ids, "\x1f")).cast("binary"), 256), 1, 20))


def evidence_ref(manifest: Column, message_id_: Column) -> Column:
    return F.concat(F.lit("e_"), F.substring(canonical_digest(F.concat(F.lit("["), json_text(manifest), F.lit(","), json_text(message_id_), F.lit("]"))), 1, 20))


def topics(text: Column, words: Mapping[str, Sequence[str]] = TOPICS) -> Column:
    """Sorted topics of which a word occurs."""
    hit = lambda ws: text.rlike("|".join(r"\Q" + w + r"\E" for w in ws))
    return F.array_sort(F.array_compact(F.array(*[F.when(hit(ws), F.lit(n)) for n, ws in words.items()])))


def query_terms(tokens: Column, stops: Sequence[str] = QUERY_STOPS) -> Column:
    """Tokens that can anchor a search: no single CJK characters, no stop words."""
    return F.filter(tokens, lambda t: ~t.rlike("^[一-鿿]$") & ~t.isin(*stops))


def event_date(text: Column, context: Column) -> Column:
    """A struct of date and explicit: the first valid 20xx-M-D, else the first valid M月D日 in the context's year, else the context's date."""
    full = F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d{2}[-年/.]\d{1,2}[-月/.]\d{1,2})"), F.lit(1))
    part = F.regexp_extract_all(text, F.lit(r"(\d{1,2}月\d{1,2})日"), F.lit(1))
    made = lambda s: F.try_to_date(F.regexp_replace(s, "[年月/.]", "-"), "yyyy-M-d")
    valid = F.array_compact(F.transform(full, made))
    dated = F.array_compact(F.transform(part, lambda s: made(F.concat(F.year(context).cast("string"), F.lit("-"), s))))
    found = F.coalesce(F.get(valid, F.lit(0)), F.get(dated, F.lit(0)))
    return F.struct(F.coalesce(found, context).alias("date"), found.isNotNull().alias("explicit"))


#: Patterns of the style redaction and their placeholders, in order.
STYLE = (
    (r"https?://[^\s]+", "<链接>"),
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<邮箱>"),
    (r"(?<!\d)(?:20\d{2}[-年/.]\d{1,2}[-月/.]\d{1,2}日?)(?!\d)", "<日期>"),
    (r"(?<!\d)(?:\+?\d[\d -]{7,}\d)(?!\d)", "<电话>"),
    (r"(?i)(?:账号|account|uid|id)\s*[:：]?\s*[A-Za-z0-9_-]{4,}", "<账号>"),
)


def style_redacted(text: Column, entities: Mapping[str, str] | None = None) -> Column:
    """Direct identifiers replaced by placeholders, then named entities, the longest first."""
    for pattern, put in STYLE:
        text = F.regexp_replace(text, pattern, put)
    for entity in sorted((entities or {}), key=len, reverse=True):
        text = F.replace(text, F.lit(entity), F.lit(entities[entity]))
    return text
