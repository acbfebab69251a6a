"""Replaces personal data with keyed, type-consistent surrogates.

Found are e-mail addresses, IPv4 addresses, phone numbers (with a country's code, an area code in brackets, or in a national form
with separators: 3-3-4 digits, also after a 1, or 9 to 12 digits after a leading 0; dates are left), card and account numbers (13 to 19 digits), social security
numbers, secrets (values after token, secret, password or key words; long hexadecimal strings) and names after a title.
A surrogate follows from a keyed hash of the type, the canonical entity (lower case, or digits without separators) and
an attempt number, and is laid into the form that it replaces: case, digits and separators stay where they are, addresses stay
addresses, card numbers that pass the Luhn check pass it again, names keep the gender of their title and their script.
So all mentions of an entity get one surrogate, in any form and in any document.

Distinct entities must get distinct surrogates, and none may be an entity of the corpus: clashes are looked for over
all entities, all but the smallest of a clash move on to their next attempt, and rounds follow until none is left. The room that
a surrogate is drawn from grows with the attempts, so that the rounds end however many entities share a narrow form. Only these
exceptions travel to the documents: as a broadcast table up to ``MOST_SENT`` rows, and beyond that by a join.

Null texts stay null and empty ones empty; texts without entities are returned as they were. Repeated rows are replaced
alike. All other columns are kept, but for one named n_entities, which the count replaces.
"""

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..session import materialize
from .text import Memo, free_name

MOST_SENT = 50_000
#: Attempts in one room; then addresses take octets of any width and other ranges, and the other kinds one more character each time.
WIDEN = 4

_TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа")}
_GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Rafael Simon Tomas Viktor".split(),
    ("f", "latin"): "Alma Berta Clara Dora Elena Frida Greta Helena Ida Julia Karin Laura Maria Nora Olga Paula Rosa Silvia Teresa Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Лидия Мария".split(),
}
_FAMILY = {
    "latin": "Abel Bergen Castell Dorn Ebner Falk Garner Holt Imhof Jansen Keller Lang Moreno Nagel Orban Prager Quandt Rainer Sander Tanner Unger Vidal Weber Zander".split(),
    "cyrillic": "Авдеенко Бондарь Ващенко Гнатюк Довженко Ерёменко Жук Зинченко Ильченко Коваль".split(),
}
_DIGITS = re.compile(r"""
    (?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))
  | (?P<national>(?<!\w)(?<!\d[.,:/-])(?:1[ .-]?\(\d{3}\)[ .-]?|(?:1[ .-])?\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|[.:/-]\d))
  | (?P<card>(?<![\d.+-])(?<![A-Za-z]\d)(?!(?:19|20)\d\d-\d\d-\d\d(?!\d))\d(?:[ -]?\d){12,18}(?![\d-]))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{2,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d))
  | (?P<trunk>(?<!\w)(?<!\d[.,:/-])(?!\d\d?(?P<sep>[./ -])\d\d?(?P=sep)(?:19|20)\d\d(?!\d))
      (?=0\d{1,4}[ ./-]\d)0(?:(?:[ ./-](?=\d\d))?\d){8,11}(?!\d|[.:/-]\d))
  | (?P<hex>(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*\d)(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))
""", re.X)
_EMAIL = re.compile(r"(?<![\w.+%-])\.*(?P<email>[\w+%-][\w.+%-]*@\w[\w-]*(?:\.\w[\w-]*)+)")
_SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?\s*[=:]\s*["']?(?P<secret>[A-Za-z0-9_\-/+.]{8,}[A-Za-z0-9_\-/+])""")
_KEYS = re.compile(r"(?<![0-9A-Za-z_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{20,})")
_NAME = re.compile(r"\b(?:" + "|".join(t for ts in _TITLES.values() for t in ts) + r")\b\.? (?P<name>[^\W\d_]+(?:-[^\W\d_]+)?(?: [^\W\d_]+)?)")
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}
_TITLE_HINT = re.compile("|".join(t + r"\.? " for ts in _TITLES.values() for t in ts))


def find(text):
    """(start, end, kind, canonical entity) of the entities of a text, in order and apart from one another."""
    found = []
    if "@" in text:
        found += [(*m.span("email"), "email", m["email"].lower()) for m in _EMAIL.finditer(text)]
    low = text.lower() if "=" in text or ":" in text else ""
    if any(w in low for w in ("token", "secret", "passw", "key")):
        found += [(*m.span("secret"), "secret", m["secret"]) for m in _SECRET.finditer(text)]
    if re.search("[0-9]", text):
        for m in _DIGITS.finditer(text):
            kind = m.lastgroup
            value = m[0].lower() if kind == "hex" else m[0] if kind == "ip" else "".join(c for c in m[0] if c.isdigit())
            code = re.match(r"\+(\d+)[^\d]", m[0]) if kind == "phone" else None
            if code:  # the country's code is kept
                value = f"+{code[1]}." + value[len(code[1]):]
            if kind in ("national", "trunk"):
                kind, value = "phone", "+1." + value[1:] if value[0] == "1" and len(value) == 11 else value
            if kind != "phone" or len(value) >= 9:
                found.append((*m.span(), "secret" if kind == "hex" else kind, value))
        found += [(*m.span(), "secret", m[0]) for m in _KEYS.finditer(text)]
    if _TITLE_HINT.search(text):
        for m in _NAME.finditer(text):
            words = [w for w in m["name"].split(" ") if w[:1].isupper()]
            if words and m["name"].startswith(words[0]):
                end = m.start("name") + len(" ".join(words))
                found.append((m.start("name"), end, "name_" + _GENDER[re.match(r"[^\W\d_]+(?:-[^\W\d_]+)?", m[0])[0]], " ".join(words).lower()))
    out, last = [], 0
    for f in sorted(found, key=lambda f: (f[0], -f[1])):
        if f[0] >= last:
            out.append(f)
            last = f[1]
    return out


class _Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key, *parts):
        self.key, self.seed, self.n, self.left = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n):
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


def _scramble(draw, text, hexadecimal=False):
    """Other letters and digits of the same kind in their places."""
    out = []
    for c in text:
        if hexadecimal and c.lower() in "0123456789abcdef":
            x = "0123456789abcdef"[draw.below(16)]
            out.append(x.upper() if text.isupper() else x)
        elif c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            start, size = ("а", 32) if "Ѐ" <= c <= "ӿ" else ("α", 17) if "Ͱ" <= c <= "Ͽ" else ("a", 26)
            x = chr(ord(start) + draw.below(size))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits):
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def surrogate(key, kind, entity, attempt=0):
    """The canonical surrogate of a canonical entity."""
    draw = _Draw(key, kind, entity, attempt)
    more = attempt // WIDEN
    if kind == "email":
        local, _, domain = entity.partition("@")
        name, _, top = domain.rpartition(".")
        return _scramble(draw, local + "x" * more) + "@" + _scramble(_Draw(key, "domain", domain), name) + "." + top
    if kind == "ip":
        parts = entity.split(".")
        keep = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] else 0
        new = parts[:keep]
        if keep and more > 1:  # another private range, and at last the reserved one, whose addresses are nobody's
            new = ["10"] if more == 2 and parts[0] != "10" else [str(240 + draw.below(15))]
        for p in parts[len(new):]:
            low, high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}[len(p)] if not more else (1, 254)
            new.append(str(low + draw.below(high - low + 1)))
        return ".".join(new)
    if kind == "secret":
        return _scramble(draw, entity + entity[-1] * more, hexadecimal=re.fullmatch("[0-9A-Fa-f]{16,}", entity) is not None)
    if kind.startswith("name"):
        script = "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in entity) else "latin"
        given, family = _GIVEN[kind[-1], script], _FAMILY[script]
        words = [given[draw.below(len(given))]] if " " in entity else []
        last = [family[draw.below(len(family))] for _ in range(1 + attempt)]  # more room at each attempt
        return " ".join([*words, "-".join(last)]).lower()
    if kind == "phone" and "." in entity:
        code, _, number = entity.partition(".")
        return code + "." + _scramble(draw, number + "0" * more)
    digits = _scramble(draw, entity + "0" * more * (kind == "phone"))
    if kind == "card" and _luhn(entity):
        digits = next(digits[:-1] + str(d) for d in range(10) if _luhn(digits[:-1] + str(d)))
    return digits


def lay(form, kind, new):
    """A canonical surrogate in the form of a mention: its separators and its case."""
    if kind in ("card", "ssn", "phone"):
        left = filter(str.isdigit, new)
        return "".join(next(left) if c.isdigit() else c for c in form) + "".join(left)  # longer after many attempts
    if kind.startswith("name"):
        if form.isupper() and len(form) > 1:
            return new.upper()
        return "".join(c.upper() if i == 0 or new[i - 1] in " -" else c for i, c in enumerate(new))
    if kind == "ip" or len(form) != len(new):
        return new
    return "".join(n.upper() if c.isupper() else n.lower() if c.islower() else n for c, n in zip(form, new))


def replace(text, key, attempts, memo=None):
    """A text with surrogates and the number of entities replaced. ``attempts``: of those (kind, entity) not at their first."""
    make = memo if memo is not None else Memo(lambda k: surrogate(key, *k))
    out, last = [], 0
    found = find(text)
    for start, end, kind, entity in found:
        out += [text[last:start], lay(text[start:end], kind, make[kind, entity, attempts.get((kind, entity), 0)])]
        last = end
    return ("".join(out) + text[last:], len(found)) if found else (text, 0)


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def entities(df):
    """Distinct (kind, entity) of all texts."""
    schema = StructType([StructField("kind", StringType()), StructField("entity", StringType())])

    def run(batches):
        for b in batches:
            got = sorted({f[2:] for t in b.column("text").to_pylist() if t for f in find(t)})
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(2)], schema=_arrow(schema))
    return df.select("text").mapInArrow(run, schema).distinct()


def assign(found, key):
    """Surrogates of all entities: kind, entity, attempt, surrogate; distinct, and none an entity. ``found``: a written table."""
    schema = StructType([*found.select("kind", "entity").schema, StructField("attempt", IntegerType()), StructField("surrogate", StringType())])

    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt"))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([surrogate(key, *r) for r in rows], pa.string())], schema=_arrow(schema))
    table = materialize(found.select("kind", "entity", F.lit(0).alias("attempt")).mapInArrow(run, schema))
    general = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    real = found.select(general.alias("family"), F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    while True:
        first = table.groupBy(general.alias("family"), "surrogate").agg(F.min(F.struct("attempt", "kind", "entity")).alias("first"), F.count(F.lit(1)).alias("n"))
        bad = first.join(real, ["family", "surrogate"], "left").where("n > 1 or real")
        clash = materialize(bad.select("family", "surrogate", F.when(F.col("real"), None).otherwise(F.col("first")).alias("first")))
        if clash.isEmpty():
            return table
        marked = table.withColumn("family", general).join(clash.withColumn("clash", F.lit(True)), ["family", "surrogate"], "left")
        stays = F.col("clash").isNull() | F.coalesce(F.col("first") == F.struct("attempt", "kind", "entity"), F.lit(False))
        moved = marked.where(~stays).select("kind", "entity", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(run, schema)
        table = materialize(marked.where(stays).select(*table.columns).unionByName(moved))


def anonymize(df, key, most_sent=MOST_SENT):
    """The rows of ``df`` with surrogates in ``text``, and the number of entities replaced in ``n_entities``."""
    exceptions = materialize(assign(materialize(entities(df)), key).where("attempt > 0").select("kind", "entity", "attempt"))
    df = df.drop("n_entities")
    few = exceptions.limit(most_sent + 1).count() <= most_sent
    listed = {(r["kind"], r["entity"]): r["attempt"] for r in exceptions.collect()} if few else {}
    sent = df.sparkSession.sparkContext.broadcast(listed)
    given, row, found_own = df, free_name(df, "own_row"), free_name(df, "own_exceptions")
    if not few:  # the exceptions of each row's own entities, by a join on a number of the row
        given = materialize(df.withColumn(row, F.monotonically_increasing_id()))
        pairs = StructType([StructField(row, LongType()), StructField("kind", StringType()), StructField("entity", StringType())])

        def mentions(batches):
            for b in batches:
                got = [(i, *f[2:]) for i, t in zip(b.column(row).to_pylist(), b.column("text").to_pylist()) if t for f in find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(_arrow(pairs))], schema=_arrow(pairs))
        own = given.select(row, "text").mapInArrow(mentions, pairs).distinct().join(exceptions, ["kind", "entity"])
        own = own.groupBy(row).agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(found_own))
        given = given.join(own, row, "left").drop(row)
    schema, columns = StructType([*df.schema, StructField("n_entities", IntegerType())]), df.columns

    def run(batches):
        memo, out = Memo(lambda k: surrogate(key, *k), 50_000), _arrow(schema)
        for b in batches:
            texts, n = [], []
            own = b.column(found_own).to_pylist() if not few else [None] * b.num_rows
            for t, o in zip(b.column("text").to_pylist(), own):
                attempts = {(x["kind"], x["entity"]): x["attempt"] for x in o} if o else sent.value
                new, k = replace(t, key, attempts, memo) if t else (t, 0)
                texts.append(new)
                n.append(k)
            cols = {**{c: b.column(c) for c in columns}, "text": pa.array(texts, out.field("text").type), "n_entities": pa.array(n, pa.int32())}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in out], schema=out)
    return given.mapInArrow(run, schema)
