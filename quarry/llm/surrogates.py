"""Personal data: detected entities get keyed, type-consistent surrogates."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import BROADCAST_BYTES, BROADCAST_ROWS, arrow_map, buffers, cut, free_names, own_columns, steps, table, text_key, with_text

#: Key of the registered query; a deployment passes its own secret.
KEY = b"quarry-surrogates"
#: Domain of surrogate addresses: reserved, so nobody's.
DOMAIN = "example"

#: Forms of address with the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Monsieur": "m", "Господин": "m", "господин": "m",
    "Mrs": "f", "Ms": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Госпожа": "f", "госпожа": "f",
    "Dr": "n", "Prof": "n",
}
#: Given names by script and gender, and family names by script; a surrogate adds syllables to them, so there is no end of distinct ones.
GIVEN = {
    ("latin", "m"): ["Alan", "Boris", "Carl", "Dario", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "n"): ["Alex", "Robin", "Kim", "Sascha", "Noel", "Charlie", "Sam", "Jody"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"],
    ("cyrillic", "f"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ольга", "Юлия"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава"],
}
FAMILY = {"latin": ["Adler", "Becker", "Castell", "Dorn", "Ebert", "Falk", "Garner", "Holm", "Jansen", "Keller", "Lindt", "Moran", "Novak", "Olsen", "Perrin", "Rossel"], "cyrillic": ["Беляков", "Волков", "Громов", "Дроздов", "Жуков", "Зимин", "Котов", "Лосев"]}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "ra", "se", "ti", "vo"], "cyrillic": ["ба", "ве", "ги", "до", "ка", "ле", "ми", "но"]}

#: Attempts after which a surrogate grows by a sign with each further one, so that no space of surrogates runs out.
GROW = 4

_NAME = r"[^\W\d_]\w*[^\W\d_]"
_V4 = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,})"
    r"|(?P<access>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b)\s*[=:]\s*[\"']?)(?P<value>(?=[+/_\-]*[A-Za-z0-9])[A-Za-z0-9+/_\-]{8,})"
    r"|(?P<ip>(?<![\w.])(?:" + _V4 + r"\.){3}" + _V4 + r"(?![\w]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))"
    r"|(?P<card>(?<![\w])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w]))"
    r"|(?P<social>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
    r"|(?<![\w+.-])\d{3}(?P<sep>[-.])\d{3}(?P=sep)\d{4}(?![\w-]|\.\d))"
    r"|(?P<title>\b(?:" + "|".join(TITLES) + r")\b\.? )(?P<name>" + _NAME + r"(?: " + _NAME + r")?)"
)
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]\w*")
_SIGNS = ("@", "AKIA", *dict.fromkeys(t + " " for t in TITLES), *dict.fromkeys(t + ". " for t in TITLES))
_WORDS = ("password", "passwd", "pwd", "secret", "token", "api")


def may_have(text: str) -> bool:
    """Whether any pattern can match at all: a cheap look before the search."""
    if _DIGIT.search(text) or any(s in text for s in _SIGNS):
        return True
    return ("=" in text or ":" in text) and any(w in text.lower() for w in _WORDS)


def script_of(word: str) -> str:
    return "cyrillic" if "\u0400" <= word[0] <= "\u04ff" else "latin" if word[0] < "\u0250" else "other"


def _stream(key: bytes, kind: str, canon: str, attempt: int) -> Iterator[int]:
    """Endless keyed numbers below 2**32 for an entity."""
    block = 0
    while True:
        d = blake2b(f"{kind}\0{canon}\0{attempt}\0{block}".encode(), key=key[:64]).digest()
        yield from (int.from_bytes(d[i : i + 4], "little") for i in range(0, 64, 4))
        block += 1


def _luhn(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (c > "4")) for i, c in enumerate(reversed(digits))) % 10


@lru_cache(maxsize=4096)
def _alphabet(letter: str) -> str:
    """Letters of the same script and case as *letter*, itself among them; never a single one."""
    if letter.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if letter.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kind, script = unicodedata.category(letter), unicodedata.name(letter, "").split(" ")[0]
    near = map(chr, range(max(128, ord(letter) - 160), min(0x10FFFF, ord(letter) + 160)))
    like = [c for c in near if unicodedata.category(c) == kind and unicodedata.name(c, "").split(" ")[0] == script and len(c.upper()) == 1 and c.upper().lower() in (c, c.lower())]
    return "".join(like) if len(like) > 1 else _alphabet("a")


def _like(canon: str, s: Iterator[int], hexed: bool = False, extra: int = 0) -> str:
    """Letters for letters of the same case and script, digits for digits, the rest as it is; *extra* more signs of the last kind."""

    def one(c: str) -> str:
        r = next(s)
        if hexed and c in "0123456789abcdef":
            return "0123456789abcdef"[r % 16]
        if c.isdecimal():
            return str(r % 10)
        return _alphabet(c)[r % len(_alphabet(c))] if c.isalpha() else c

    last = next((c for c in reversed(canon) if c.isdecimal() or c.isalpha()), "a")
    return "".join(map(one, canon + last * extra))


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0, gender: str = "n") -> str:
    """The canonical form that stands for *canon*: a keyed function of kind, value, gender and attempt.

    Every kind has other values at every attempt, and from attempt GROW on the values are longer by one sign
    each time (an address of version 4 becomes one of version 6), so that there is always a free one.
    """
    s = _stream(key, kind, canon, attempt)
    grown = max(0, attempt - GROW + 1)
    if kind == "email":
        local, domain = canon.split("@", 1)
        names = _stream(key, "domain", domain, 0)  # addresses of one domain stay in one domain
        extra = "".join(SYLLABLES["latin"][next(s) % 12] for _ in range(attempt))
        return f"{_like(local, s)}{extra}@{_like(domain.rsplit('.', 1)[0], names)}.{DOMAIN}"
    if kind == "ip":  # ranges that are reserved and never routed
        if ":" in canon or grown:
            return str(ipaddress.IPv6Address((0x20010DB8 << 96) | sum(next(s) << (32 * i) for i in range(3))))
        return ".".join(str(x) for x in (240 + next(s) % 15, *(next(s) % 256 for _ in range(3))))
    if kind in ("card", "phone", "social"):
        digits = canon.lstrip("+")
        keep = len(digits) - 10 if kind == "phone" and canon[0] == "+" and len(digits) > 10 else 0  # the country's part stays
        first = str(2 + next(s) % 8) if kind == "phone" else str(1 + next(s) % 9)
        out = digits[:keep] + first + "".join(str(next(s) % 10) for _ in range(len(digits) - keep - 1 + grown))
        if kind == "card":  # a valid number gets a valid one
            out = next(out[:-1] + d for d in "0123456789" if _luhn(out[:-1] + d) == 0)
        return "+" * (canon[0] == "+") + out
    if kind == "access":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[next(s) % 32] for _ in canon[4:])
    if kind == "secret":
        return _like(canon, s, re.fullmatch(r"[0-9a-f]+", canon) is not None, grown)
    script = script_of(canon)
    if script == "other":
        return _like(canon, s, extra=attempt)
    stem = FAMILY[script] if kind == "family" else GIVEN[script, gender]
    word = stem[next(s) % len(stem)].lower()
    tail = "".join(SYLLABLES[script][next(s) % len(SYLLABLES[script])] for _ in range(2 + attempt))
    if kind == "family":
        return word + tail + "ва" * (script == "cyrillic" and canon.endswith("а"))
    return tail + word if gender != "n" else word + tail  # the ending shows the gender


def _ascii_digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _address6(text: str) -> str | None:
    """The canonical form of an address of version 6; none for times, operators and what else has colons."""
    if sum(map(bool, text.split(":"))) < 3 or not _DIGIT.search(text):
        return None
    try:
        return str(ipaddress.IPv6Address(text))
    except ValueError:
        return None


Entity = tuple[int, int, str, str, str]


def entities(text: str | None) -> list[Entity]:
    """Start, end, kind, canonical form and gender (given names: m, f or n; else empty) of every entity, in order.

    Copies in other spellings have one canonical form. A name that stands after a form of address anywhere in the
    text is found at its other mentions too, with or without a form of address.
    """
    if not text or not may_have(text):
        return []
    out: list[Entity] = []
    names: dict[str, str] = {}
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if kind == "value":
            out.append((*m.span("value"), "secret", m["value"], ""))
        elif kind == "name":
            gender = TITLES[m["title"].rstrip(" .")]
            at, parts = m.start("name"), m["name"].split(" ")
            if parts[0][0].islower():
                continue
            if parts[-1][0].islower():  # the word after a name
                parts.pop()
            for i, p in enumerate(parts):
                kind = "given" if i < len(parts) - 1 else "family"
                names.setdefault(p.lower(), kind)
                out.append((at, at + len(p), kind, p.lower(), gender if kind == "given" else ""))
                at += len(p) + 1
        elif kind == "email":
            out.append((*m.span(), kind, m[0].lower(), ""))
        elif kind == "ip":
            out.append((*m.span(), kind, ".".join(str(int(x)) for x in m[0].split(".")), ""))
        elif kind == "ip6":
            if address := _address6(m[0]):
                out.append((*m.span(), "ip", address, ""))
        elif kind in ("card", "phone", "social"):
            digits = _ascii_digits(m[0])
            if kind != "card" or _luhn(digits) == 0:
                out.append((*m.span(), kind, "+" * (m[0][0] == "+") + digits, ""))
        else:
            out.append((*m.span(), kind, m[0], ""))
    return _with_mentions(text, out, names) if names else out


def _with_mentions(text: str, found: list[Entity], names: dict[str, str]) -> list[Entity]:
    """*found* with every other mention of the *names* (lower case, with their kinds), and one kind for each name of the text."""
    found = [(s, e, names.get(c, k) if k in ("given", "family") else k, c, g) for s, e, k, c, g in found]
    ends, out, at = [e[1] for e in found], list(found), 0
    for m in _WORD.finditer(text):
        while at < len(found) and ends[at] <= m.start():
            at += 1
        word = m[0].lower()
        if word in names and not m[0][0].islower() and not (at < len(found) and found[at][0] < m.end()):
            out.append((*m.span(), names[word], word, "n" if names[word] == "given" else ""))
    return sorted(out)


def rendered(original: str, kind: str, value: str) -> str:
    """*value* in the spelling of *original*: its separators and its case. No sign of the value is lost."""
    if kind in ("card", "phone", "social"):
        digits = iter(value.lstrip("+"))
        return "".join([next(digits) if c.isdecimal() else c for c in original]) + "".join(digits)
    if kind in ("family", "given"):
        return value.upper() if len(original) > 1 and original.isupper() else value.capitalize()
    return value.upper() if kind == "email" and original.isupper() else value


def compared(kind: Column, value: Column) -> Column:
    """What must differ: digits of a number whatever its spelling, else the value."""
    return F.when(kind.isin("card", "phone", "social"), F.ltrim(value, F.lit("+"))).otherwise(value)


def _entity_table(d: DataFrame) -> DataFrame:
    """Distinct kind and canon of all texts, with the gender that most forms of address tell (n where none or as many of both)."""

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen = Counter(e[2:] for t in b.column("text") for e in entities(t.as_py()))
        if seen:
            k, c, g = zip(*seen, strict=True)
            n = [(g == "f") - (g == "m") for g in g]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array([x * y for x, y in zip(n, seen.values(), strict=True)], pa.int64())], names=["kind", "canon", "lean"])

    lean = F.sum("lean")
    gender = F.when(F.col("kind") != "given", "").when(lean > 0, "f").when(lean < 0, "m").otherwise("n")
    return arrow_map(d.select("text"), work, "kind string, canon string, lean long").groupBy("kind", "canon").agg(gender.alias("gender"))


def settled_attempts(known: DataFrame, key: bytes = KEY) -> DataFrame:
    """*known* (kind, canon, gender) with the attempt whose surrogate collides with none.

    A surrogate must differ, as it is written, from those of all other entities of its kind (all names are one
    kind here) and from every entity that the corpus holds. Of several with the same surrogate the smallest keeps it;
    the others try again. The spaces of values grow with the attempts, so fewer are left each time and the rounds end.
    """
    known = cut(known.select("kind", "canon", "gender"))

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(*[b.column(c).to_pylist() for c in ("kind", "canon", "attempt", "gender")], strict=True)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], names=["kind", "canon", "gender", "attempt", "value"])

    group = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    real = known.select(group.alias("group"), compared(F.col("kind"), F.col("canon")).alias("value")).distinct().withColumn("is_real", F.lit(True))
    open_, settled = known.withColumn("attempt", F.lit(0)), None
    while True:
        tried = arrow_map(open_, work, "kind string, canon string, gender string, attempt int, value string")
        tried = cut(tried.withColumn("group", group).withColumn("value", compared(F.col("kind"), F.col("value"))).withColumn("fresh", F.lit(True)))
        every = tried if settled is None else tried.unionByName(settled.withColumn("fresh", F.lit(False)))
        holder = every.groupBy("group", "value").agg(F.min(F.struct("fresh", "kind", "canon")).alias("first"))
        judged = tried.join(holder, ["group", "value"]).join(real, ["group", "value"], "left")
        fine = F.col("first.fresh") & (F.col("first.kind") == F.col("kind")) & (F.col("first.canon") == F.col("canon")) & F.col("is_real").isNull()
        judged = cut(judged.select("group", "kind", "canon", "gender", "attempt", "value", fine.alias("fine")))
        good = judged.filter("fine").drop("fine")
        settled = good if settled is None else settled.unionByName(good)
        open_ = judged.filter("not fine").select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt"))
        if not open_.take(1):
            return settled.select("kind", "canon", "gender", "attempt")


def replace_entities(docs: DataFrame, key: bytes = KEY, sent_rows: int = BROADCAST_ROWS) -> DataFrame:
    """*docs* with surrogates in text, and n_entities and kinds (sorted, comma-joined); n_chars follows where present.

    E-mail addresses, phone, card (valid check digit) and social numbers, IP addresses, access keys, passwords and
    tokens, and names are found in whole texts. A name is found after a form of address, and then at all its mentions in
    the text. An entity's surrogate is a keyed function of its canonical form, so all mentions in all documents stay one
    entity, in the format of each mention: digits and separators, valid card numbers valid, hexadecimal secrets
    so, addresses from reserved ranges, names of the same script and of the gender that the corpus tells of the name. Distinct entities
    stay distinct: collisions are looked for among the distinct entities of the corpus, and what a surrogate
    needs beside the entity (a later attempt, a gender) is sent along, or joined to the documents beyond *sent_rows*.

    Null texts, and all of a table without texts, stay null and have none. Rows stay as they are, repeats too; columns
    named n_entities or kinds are replaced, all others stay. An empty table gives an empty result.
    """
    source = with_text(docs.drop(*[c for c in docs.columns if c.lower() in ("n_entities", "kinds")]))
    columns = source.columns
    notes = cut(settled_attempts(_entity_table(source), key).filter("attempt > 0 or gender in ('m', 'f')"))
    size = notes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("canon")), F.lit(0)).alias("chars")).first()
    sent = noted = None
    if size.n <= sent_rows and 4 * size.chars <= BROADCAST_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast({(r.kind, r.canon): (r.attempt, r.gender) for r in notes.collect()})
    else:
        source, noted = _with_notes(source, notes)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j in steps(buffers(batch.column("text"))[0]):
            b = batch.slice(i, j - i)
            texts, counts, kinds = [], [], []
            own = b.column(noted).to_pylist() if noted else None
            for i, t in enumerate(b.column("text").to_pylist()):
                found = entities(t)
                get = (sent.value if sent else {(x["kind"], x["canon"]): (x["attempt"], x["gender"]) for x in own[i] or []}).get
                out, at = [], 0
                for s, e, kind, canon, _ in found:
                    out += [t[at:s], rendered(t[s:e], kind, surrogate(key, kind, canon, *get((kind, canon), (0, "n"))))]
                    at = e
                texts.append("".join([*out, t[at:]]) if found else t)
                counts.append(len(found))
                kinds.append(",".join(sorted({e[2] for e in found})))
            new = {"text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64()), "kinds": pa.array(kinds, pa.string())}
            names = [*columns, "n_entities", "kinds"]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in columns] + ["n_entities long", "kinds string"])
    out = arrow_map(source, work, schema)
    chars = next((c for c in columns if c.lower() == "n_chars"), None)
    return out.withColumn(chars, F.length("text").cast(dict(docs.dtypes)[chars])) if chars else out


def _with_notes(docs: DataFrame, notes: DataFrame) -> tuple[DataFrame, str]:
    """*docs* with one more column, the notes on the entities of each, and its name; only those documents' entities are shuffled."""
    k, noted = free_names(docs, "_k", "_notes")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for x, y in steps(buffers(batch.column("text"))[0]):
            b = batch.slice(x, y - x)
            rows = [(h, *e) for h, t in zip(*[b.column(c).to_pylist() for c in (k, "text")], strict=True) for e in {x[2:4] for x in entities(t)}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[k, "kind", "canon"])

    d = docs.withColumn(k, text_key("text"))
    used = arrow_map(d.select(k, "text"), work, f"{k} long, kind string, canon string").distinct()
    per_text = used.join(notes, ["kind", "canon"]).groupBy(k).agg(F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias(noted))
    return d.join(per_text, k, "left").drop(k), noted


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(own_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
