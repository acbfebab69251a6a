"""Column -> Column functions used across the operators."""

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def lookup(col, mapping, default=None):
    """Value of a fixed map, with a default for unknown keys."""
    m = F.create_map(*[F.lit(x) for x in chain(*mapping.items())])
    v = F.try_element_at(m, F.col(col) if isinstance(col, str) else col)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def categorize(desc, word_boundary=False) -> Column:
    """First category whose keyword occurs in the lower-cased text.

    The text is lower-cased once, not once a category. Keywords are plain strings, so ``contains`` finds them; a pattern of
    alternatives tries each of them at every place.
    """
    def first(low):
        out = None
        for name, words in S.CATEGORY_KEYWORDS.items():
            if word_boundary:
                hit = low.rlike(rf"\b({'|'.join(re.escape(w) for w in words)})\b")
            else:
                hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(S.CATEGORY_DEFAULT)
    return F.get(F.transform(F.array(F.lower(desc)), first), F.lit(0))


def category_name(code) -> Column:
    return lookup(code, S.CATEGORY_NAMES, S.CATEGORY_NAME_DEFAULT)


def short_name(desc, width=50) -> Column:
    return F.when(F.length(desc) <= width, desc).otherwise(F.concat(F.substring(desc, 1, width - 3), F.lit("...")))


def email_of(customer_id, prefix=S.EMAIL_PREFIX, suffix=S.EMAIL_SUFFIX) -> Column:
    return F.concat(F.lit(prefix), customer_id.cast("string"), F.lit(suffix))


def customer_of(email, prefix=S.EMAIL_PREFIX, suffix=S.EMAIL_SUFFIX) -> Column:
    """Customer id inside an address; null when the address does not carry one."""
    digits = F.regexp_extract(email, f"^{re.escape(prefix)}(-?\\d+){re.escape(suffix)}$", 1)
    return digits.try_cast("bigint")


def pseudonym(customer_id) -> tuple[Column, Column]:
    """First and last name picked by the last two decimal digits of the id's MD5."""
    h = F.md5(customer_id.cast("string"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int"))
    rest = F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % 100)
    first = F.get(F.array(*[F.lit(n) for n in S.FIRST_NAMES]), rest % 10)
    last = F.get(F.array(*[F.lit(n) for n in S.LAST_NAMES]), F.floor(rest / 10).cast("int"))
    return first, last


def to_cents(pounds) -> Column:
    """Half-even rounding to whole cents."""
    return F.bround(pounds * 100, 0).cast("long")


def month_key(ts) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_bucket(ts, iso=False) -> Column:
    """First day of the week: Tuesday-to-Monday weeks by default, Monday weeks with ``iso``."""
    d = F.to_date(ts)
    if iso:
        return F.to_date(F.date_trunc("week", d))
    return F.date_add(F.to_date(F.date_trunc("week", F.date_sub(d, 1))), 1)


def whole_days(later, earlier) -> Column:
    """Floor of a time difference in days."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("int")


def ladder(col, steps, otherwise, op="<=") -> Column:
    """Score of the first threshold met, tried in order."""
    out = None
    for bound, score in steps:
        hit = (col <= bound) if op == "<=" else (col >= bound)
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(otherwise)


def r_score(recency) -> Column:
    return ladder(recency, [(30, 5), (90, 4), (180, 3), (365, 2)], 1)


def f_score(frequency) -> Column:
    return ladder(frequency, [(20, 5), (10, 4), (5, 3), (2, 2)], 1, ">=")


def m_score(monetary, unit="cents") -> Column:
    k = 100 if unit == "cents" else 1
    return ladder(monetary, [(5000 * k, 5), (2000 * k, 4), (500 * k, 3), (100 * k, 2)], 1, ">=")


def risk_level(prob, threshold=0.5, high=0.85) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(prob >= high, "high").when(prob >= t, "medium").otherwise("low")


def json_list(col) -> Column:
    """JSON array of strings; other non-empty text becomes a one-item list."""
    return F.coalesce(
        F.from_json(col, "array<string>"),
        F.when(col.isNotNull() & ~col.isin("", "[]"), F.array(col)),
        F.array().cast("array<string>"))


def rule_text(items, tag=None, width=200) -> Column:
    """Comma list cut to ``width``, with an optional group tag in front."""
    text = F.array_join(items, ", ")
    if tag is not None:
        text = F.concat(F.lit("["), tag, F.lit("] "), text)
    return F.substring(text, 1, width)


def percent_of(part, total, places=1) -> Column:
    """Share of a total in percent; 0 when the total is 0."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, total), places), F.lit(0.0))


# Number words, quantity phrases, joining words and small dictionaries for product names.
NUMBER_WORDS = {
    "ONE": "1", "TWO": "2", "THREE": "3", "FOUR": "4", "FIVE": "5", "SIX": "6", "SEVEN": "7", "EIGHT": "8",
    "NINE": "9", "TEN": "10", "ELEVEN": "11", "TWELVE": "12", "TWENTY": "20", "THIRTY": "30", "FORTY": "40",
    "FIFTY": "50", "SIXTY": "60",
}
# (pattern, what the phrase becomes: group numbers and literal text, as regexp_extract takes them); patterns that an earlier one
# always precedes are left out
QUANTITY_PHRASES = [
    (r"^SET OF (\d+) (.+)", [1, 2, "件套"]), (r"^SET/(\d+) (.+)", [1, 2, "件套"]), (r"^SET (\d+) (.+)", [1, 2, "件套"]),
    (r"^SET3 (.+)", [1, "3件套"]), (r"^PACK OF (\d+) (.+)", [1, 2, "件装"]), (r"^PACK (\d+) (.+)", [1, 2, "件装"]),
    (r"^(\d+) PACK (.+)", [1, 2, "件装"]), (r"^(.+) (\d+) PACK$", [1, 2, "件装"]), (r"^(\d+) (.+) SET$", [2, 1, "件套"]),
    (r"^(\d+) PC (.+)", [2, 1, "件套"]), (r"^(\d+) PIECE (.+)", [2, 1, "件套"]),
]
STOP_WORDS = [
    "IN", "WITH", "FOR", "AND", "THE", "A", "AN", "OF", "ON", "TO", "BY", "AT", "FROM", "OR", "AS", "IS", "ARE",
    "WAS", "WERE", "BE", "BEEN", "BEING", "HAVE", "HAS", "HAD", "DO", "DOES", "DID", "WILL", "WOULD", "SHOULD", "CAN",
    "COULD", "MAY", "MIGHT", "THIS", "THAT", "THESE", "THOSE", "IT", "ITS", "MY", "YOUR", "HIS", "HER", "OUR",
    "THEIR", "WE", "YOU", "HE", "SHE", "THEY", "WHAT", "WHICH", "WHO", "WHOM", "WHOSE", "WHERE", "WHEN", "WHY", "HOW",
    "NOT", "NO", "ONLY", "OWN", "SAME", "SO", "THAN", "TOO", "VERY", "JUST", "ABOUT", "ABOVE", "AFTER", "AGAIN",
    "ALL", "ALSO", "AM", "ANOTHER", "ANY", "BECAUSE", "BEFORE", "BELOW", "BETWEEN", "BOTH", "BUT", "CALL", "COME",
    "DAY", "DOWN", "EACH", "EVEN", "EVERY", "FIND", "FIRST", "GET", "GOOD", "GREAT", "HERE", "HIGH", "HIM", "HIMSELF",
    "IF", "INTO", "KEEP", "LAST", "LIKE", "LONG", "LOOK", "MAKE", "MANY", "MORE", "MOST", "MUCH", "MUST", "MYSELF",
    "NEW", "NOW", "OFF", "OLD", "OTHER", "OUT", "OVER", "PART", "PEOPLE", "PUT", "SAID", "SEE", "SHOW", "SIDE",
    "SMALL", "SOME", "SOUND", "STILL", "SUCH", "TAKE", "THEM", "THEN", "THING", "THINK", "THOUGH", "THREE", "THROUGH",
    "TIME", "UNDER", "UNTIL", "UP", "USE", "WANT", "WAY", "WELL", "WHILE", "WORDS", "WORK", "WORLD", "WRITE", "YEAR",
    "YOURS",
]
COLORS = {
    "RED": "红色", "BLUE": "蓝色", "GREEN": "绿色", "PINK": "粉色", "WHITE": "白色", "BLACK": "黑色", "YELLOW": "黄色",
    "PURPLE": "紫色", "ORANGE": "橙色", "GREY": "灰色", "GOLD": "金色", "SILVER": "银色", "BROWN": "棕色", "CREAM": "奶油色",
    "IVORY": "象牙白", "NATURAL": "自然色", "CLEAR": "透明", "MIXED": "混色", "MULTI": "多彩", "LIME": "青柠色",
    "TURQUOISE": "绿松石色", "LILAC": "淡紫色", "PEACH": "桃色", "NAVY": "藏青色", "BEIGE": "米色", "CORAL": "珊瑚色",
}
MATERIALS = {
    "WOODEN": "木质", "CERAMIC": "陶瓷", "GLASS": "玻璃", "METAL": "金属", "FELT": "毛毡", "FELTCRAFT": "毛毡手工",
    "ENAMEL": "珐琅", "ZINC": "锌合金", "CRYSTAL": "水晶", "ACRYLIC": "亚克力", "WOOL": "羊毛", "WOOLLY": "羊毛", "SILK": "丝绸",
    "LINEN": "亚麻布", "WICKER": "藤编", "LEATHER": "皮革", "CANVAS": "帆布", "CHROME": "铬色", "BRASS": "黄铜", "COPPER": "铜",
    "PLASTIC": "塑料", "RUBBER": "橡胶", "FOAM": "泡沫", "PADDED": "填充", "SOFT": "柔软", "FLAT": "扁平", "PAINTED": "彩绘",
    "HANDMADE": "手工制作", "HAND": "手工",
}


def _longest_first(d):
    return sorted(d.items(), key=lambda kv: -len(kv[0]))


def _replace_all(text, pairs, wrap):
    """Apply every (key, value) pair in turn inside one ``aggregate`` over a constant array."""
    table = F.array(*[F.struct(F.lit(wrap(k)).alias("p"), F.lit(v).alias("r")) for k, v in pairs])
    return F.aggregate(table, text, lambda acc, e: F.regexp_replace(acc, e["p"], e["r"]))


def normalize_product_name(name, dictionaries=(MATERIALS, COLORS)) -> Column:
    """Translate a product name with ordered dictionaries, then strip what stayed Latin.

    Larger product and style vocabularies are passed in ``dictionaries``, in the
    order they apply; within one, longer keys win. A blank outcome gives the
    trimmed original back. All steps are built-in string functions.
    """
    base = F.trim(name)
    t = base
    for a, b in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = _replace_all(t, _longest_first(NUMBER_WORDS), lambda k: rf"(?iU)\b{k}\b")
    phrase = None
    for pat, parts in QUANTITY_PHRASES:
        pat = "(?i)" + pat
        done = F.trim(F.concat(*[F.regexp_extract(t, pat, p) if isinstance(p, int) else F.lit(p) for p in parts]))
        phrase = F.when(t.rlike(pat), done) if phrase is None else phrase.when(t.rlike(pat), done)
    t = phrase.otherwise(t)
    for d in dictionaries:
        t = _replace_all(t, _longest_first(d), lambda k: "(?i)" + re.escape(k))
    t = F.regexp_replace(t, r"(?iU)\b(" + "|".join(STOP_WORDS) + r")\b", "")
    t = F.regexp_replace(t, r"(?U)\s+", "")
    t = F.regexp_replace(t, r"[&+/,]", "·")
    t = F.regexp_replace(t, r"[-']", "")
    t = F.regexp_replace(t, r"[A-Za-z]", "")
    t = F.regexp_replace(F.regexp_replace(t, "·+", "·"), "^·|·$", "")
    return F.when(name.isNull() | (F.length(base) < 2), name).when(t == "", base).otherwise(t)


def normalize_names(df: DataFrame, col, out, **kw) -> DataFrame:
    """Normalise the distinct names once and join the result back."""
    names = df.select(col).distinct()
    return df.join(names.withColumn(out, normalize_product_name(F.col(col), **kw)), col, "left")
