"""Surrogates for personal data (operator 7).

Detected entities are replaced by keyed surrogates of the same kind: digits for digits in the mention's own format (card
numbers stay valid if they were), addresses for addresses, mail names of the same shape, secrets of the same character
classes, person names of the same gender and script. An entity is its canonical form (lower case, digits only, a name
without its title, ...), so that all mentions of it, in whatever format and document, get one surrogate: coreference holds.
A full name that the corpus has anywhere after a title or with a listed given name is looked up in every document.
Within a document, the full name or a part of it stands for a person who is named in full there, with or without a title;
a part alone is not replaced after "a" or "an", nor in upper case unless the text has the person in upper case.
A person's gender is the one that a title tells anywhere in the corpus, else the given name's. Distinct entities keep
distinct surrogates: Spark collects the corpus's entities as a table, draws a surrogate for each, and draws again, with the
next counter, for those whose surrogate is another entity's surrogate or a real entity of the corpus, until none is.

Persons whose full name the corpus has nowhere after a title or with a listed given name are not detected.
Very long texts are searched whole. Ties: of two persons in a document who share a part of their names, the part alone
stands for the first. Null texts stay null, empty ones empty, texts without an entity are returned as they are. Repeated rows get equal results.
An empty table gives an empty result. Extra columns pass through; a column that has the name of a result is replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import sys
from collections.abc import Container, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise
from ._text import steps, text_udf

KEY = b"surrogates"
#: Redrawn entities and full names that tasks get as a plain table (some 10 MB at most); with more of them, they are joined to the texts.
PLAIN_TABLE = 100_000

#: Titles by gender.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "Κυρία"), "n": ("Dr", "Prof", "Mx")}
#: Given names by script and gender, and syllables for family names by script.
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Simon", "Tomas", "Victor"),
    ("latin", "f"): ("Alma", "Bianca", "Clara", "Diana", "Emma", "Flora", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Vera"),
    ("latin", "n"): ("Alex", "Andrea", "Charlie", "Dominique", "Jo", "Kim", "Robin", "Sascha"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Лев", "Олег", "Пётр"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"),
    ("cyrillic", "n"): ("Женя", "Саша", "Валя", "Слава"),
    ("greek", "m"): ("Άρης", "Γιώργος", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "n"): ("Αλέξ", "Χρίσ"),
}
SYLLABLES = {
    "latin": ("bar", "ben", "cor", "dal", "den", "fel", "gar", "hol", "jan", "kel", "lin", "mar", "mon", "nor", "pel", "ran", "ros", "sal", "ter", "tor", "val", "ver", "wil", "zan"),
    "cyrillic": ("бел", "вол", "гор", "дан", "зол", "кар", "лаз", "мор", "нов", "пав", "род", "сор", "тар", "фед", "чер", "яр"),
    "greek": ("αλ", "βασ", "γερ", "δημ", "καλ", "λαμ", "μαρ", "νικ", "παπ", "σταυ", "τσι", "χατζ"),
}
_TITLE = "|".join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True))
_SECRET = r"token|secret|passwd|password|api[_-]?key|access[_-]?key|auth"
_GENDER = {x.casefold(): gender for (_, gender), names in GIVEN.items() for x in names}
_GIVEN = "|".join(sorted((x for names in GIVEN.values() for x in names), key=len, reverse=True))
_CAPITAL = r"[^\W\d_a-zа-яα-ω][^\W\d_]+"
#: Beginnings of well-known kinds of keys.
_KEYS = r"AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*|-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
ENTITY = re.compile(
    rf"""(?P<secret>(?ai:(?<![A-Za-z0-9])(?:{_SECRET}))["']?\s*[:=]\s*(?:"(?P<quoted>[^"\n]{{6,}})"|'(?P<single>[^'\n]{{6,}})'|["']?(?P<value>[\w\-./+]{{8,}}[^\s"',;<>)]*)))
    |(?P<bare>(?<![A-Za-z0-9])(?:{_KEYS}))
    |(?P<email>(?<![\w.+-])[\w.+%-]{{1,64}}@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{{2,24}})
    |(?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))
    |(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}})(?![\w:]))
    |(?P<phone>(?<![\w+])\+\d{{1,3}}(?:[ .-]?\(\d{{1,5}}\))?(?:[ .-]?\d{{2,5}}){{2,5}}(?!\d)|(?<![\w(])\(\d{{3}}\)[ ]?\d{{3}}[ .-]\d{{4}}(?!\d)|(?<![\w.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-]))
    |(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    |(?P<card>(?<![\w.-])\d(?:[ -]?\d){{12,18}}(?![\w]))
    |(?P<person>\b(?P<title>{_TITLE})\.?[ ](?P<name>{_CAPITAL}(?:[ -]{_CAPITAL}){{0,2}})|\b(?P<untitled>(?:{_GIVEN})(?:[ -]{_CAPITAL}){{1,2}}))""",
    re.VERBOSE,
)
_SIGN, _NAME = re.compile(r"[@\d]"), re.compile(r"[A-Z\u00c0-\u00de\u0370-\u03ff\u0410-\u042f][^\W\d_]+")
_NAMES = frozenset(x for names in [*TITLES.values(), *GIVEN.values()] for x in names)
_PLAIN = ("::", "-----BEGIN", "eyJ", "xox", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", *sorted(x for x in _NAMES if not _NAME.fullmatch(x)))
_WORDS = ("token", "secret", "passw", "api", "access", "auth")
_GROUPS = re.compile(r"[A-Fa-f]:[A-Fa-f]{1,4}:")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(rf"\b{_CAPITAL}(?:[ -]{_CAPITAL})+")
#: Articles after which a part of a name is a common word.
_ARTICLES = re.compile(r"(?<!\w)(?:a|an)\s\Z", re.IGNORECASE)


def may_hold(text: str) -> bool:
    """False for most texts without an entity, by searches much faster than ENTITY; never for one that holds any."""
    if _SIGN.search(text) or (text.count(":") > 6 and _GROUPS.search(text)) or any(x in text for x in _PLAIN) or not _NAMES.isdisjoint(_NAME.findall(text)):
        return True
    low = text.lower()
    return any(x in low for x in _WORDS)


KINDS = ("secret", "bare", "email", "iban", "ip", "ipv6", "phone", "ssn", "card", "person")
_TOLD = {title: gender for gender, titles in TITLES.items() for title in titles if gender != "n"}


def mentions(text: str, names: Container[str] = ()) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order; start to end is what gets replaced."""
    return [x[:4] for x in found(text, names)]


def found(text: str, names: Container[str] = ()) -> list[tuple[int, int, str, str, str | None]]:
    """mentions with the gender that a title tells; names are full names of persons that are looked up as well."""
    out: list[tuple[int, int, str, str, str | None]] = []
    persons = False
    for m in ENTITY.finditer(text) if may_hold(text) else ():
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
        if kind == "secret":
            group = next(g for g in ("quoted", "single", "value") if m[g] is not None)
            out.append((*m.span(group), kind, m[group], None))
        elif kind == "bare":
            out.append((*m.span(), "secret", m[0], None))
        elif kind == "person":
            persons, group = True, "name" if m["name"] else "untitled"
            out.append((*m.span(group), kind, " ".join(m[group].casefold().split()), _TOLD.get(m["title"])))
        elif kind in ("phone", "ssn", "card"):
            out.append((*m.span(), kind, re.sub(r"\D", "", m[0]), None))
        else:
            out.append((*m.span(), kind, m[0].replace(" ", "").upper() if kind == "iban" else m[0].lower(), None))
    if names:
        taken = [x[:2] for x in out]
        known = [(a, b, "person", name, None) for a, b, name in _runs(text, names) if _is_free(taken, a, b)]
        out, persons = sorted(out + known) if known else out, persons or bool(known)
    return _coreferent(text, out) if persons else out


def _runs(text: str, names: Container[str] | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, full name) where two or three capitalised words in a row are one of names, the longest first; None: all of them."""
    for m in _RUN.finditer(text):
        words = [(m.start() + w.start(), m.start() + w.end()) for w in _WORD.finditer(m[0])]
        low, at = m[0].casefold(), 0
        plain = len(low) == len(m[0])
        while at + 1 < len(words):
            step = 1
            for n in (3, 2):
                if at + n <= len(words):
                    a, b = words[at][0], words[at + n - 1][1]
                    name = low[a - m.start() : b - m.start()] if plain else text[a:b].casefold()
                    if names is None:
                        yield a, b, name
                    elif name in names:
                        yield a, b, name
                        step = n
                        break
            at += step


def _is_free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    place = bisect.bisect_right(taken, (start, sys.maxsize))
    return (place == 0 or taken[place - 1][1] <= start) and (place == len(taken) or taken[place][0] >= end)


def _coreferent(text: str, out: list) -> list:
    """Parts of a name that stands in full somewhere in the text are that person, wherever they stand."""
    whole: dict[str, str] = {}
    upper = set()
    for a, b, kind, name, _ in out:
        if kind == "person" and " " in name:
            for x in (name, *(p for p in name.split() if len(p) > 2)):
                whole.setdefault(x, name)
                if text[a:b].isupper():
                    upper.add(x)
    if not whole:
        return out
    out = [(a, b, kind, whole.get(x, x) if kind == "person" else x, told) for a, b, kind, x, told in out]
    taken, known = [(a, b) for a, b, *_ in out], re.compile(r"(?<!\w)(?:" + "|".join(re.escape(x).replace(r"\ ", r"\s") for x in sorted(whole, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    for m in known.finditer(text):
        name = " ".join(m[0].casefold().split())
        common = " " not in name and ((m[0].isupper() and name not in upper) or _ARTICLES.search(text, max(0, m.start() - 4), m.start()))
        if m[0][0].isupper() and not common and _is_free(taken, *m.span()):
            out.append((*m.span(), "person", whole[name], None))
    return sorted(out)


def gender_of(name: str) -> str:
    return next((_GENDER[x] for x in re.split(r"[ -]", name) if x in _GENDER), "n")


def script(text: str) -> str:
    return next((name for name, low, high in (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ")) if any(low <= c <= high for c in text)), "latin")


class Stream:
    """Keyed numbers that depend on what only."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.seed, self.left, self.round = hmac.new(key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest(), b"", 0

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left, self.round = hashlib.sha256(self.seed + self.round.to_bytes(4, "big")).digest(), self.round + 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value * n >> 32

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case, hexadecimal if the text is; the rest stays."""
        hexadecimal = not text.isdigit() and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
        out = []
        for c in text:
            if hexadecimal:
                out.append(("0123456789ABCDEF" if text.upper() == text else "0123456789abcdef")[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                x = chr(97 + self.below(26))
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)

    def word(self, letters: str, syllables: int) -> str:
        return "".join(SYLLABLES[letters][self.below(len(SYLLABLES[letters]))] for _ in range(syllables))


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


def surrogate(kind: str, canonical: str, attempt: int = 0, key: bytes = KEY, gender: str | None = None) -> str:
    """The attempt-th surrogate of an entity, in canonical form. Later attempts draw from ever more names."""
    draw = Stream(key, kind, canonical, attempt)
    if kind == "email":
        name, _, host = canonical.partition("@")
        parts = [draw.word("latin", 2 + min(attempt, 6)) if re.search(r"[^\W\d]", x) else draw.like(x) for x in re.split(r"[._+%-]", name)]
        marks = re.findall(r"[._+%-]", name)
        site = Stream(key, "host", host)
        return "".join(a + b for a, b in zip(parts, [*marks, ""], strict=True)) + f"@{site.word('latin', 3)}{site.below(1000)}.example"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":
        return "".join("0123456789abcdef"[draw.below(16)] if c != ":" else c for c in canonical)
    if kind == "person":
        gender, letters = gender or gender_of(canonical), script(canonical)
        count = len(re.split(r"[ -]", canonical))
        given = [GIVEN[letters, gender][draw.below(len(GIVEN[letters, gender]))] for _ in range(count - 1)]
        return " ".join([*given, draw.word(letters, 3 + min(attempt, 6)).capitalize()]).casefold()
    if kind == "iban":
        body = draw.like(canonical[4:])
        valid = _mod97(canonical[4:] + canonical[:4]) == 1
        return canonical[:2] + (f"{98 - _mod97(body + canonical[:2] + '00'):02d}" if valid else draw.like(canonical[2:4])) + body
    if kind == "phone":
        keep = min(len(canonical) - 6, 1) if len(canonical) > 7 else 0
        return canonical[:keep] + draw.like(canonical[keep:])
    if kind == "card":
        out = str(1 + draw.below(9)) + draw.like(canonical[1:])
        if luhn(canonical) == 0:
            out = next(x for x in (out[:-1] + str(d) for d in range(10)) if luhn(x) == 0)
        return out
    return draw.like(canonical)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def render(mention: str, kind: str, canonical: str, of: str = "") -> str:
    """A canonical surrogate in the format of the mention that it replaces; of: the entity's own canonical form."""
    if kind in ("phone", "ssn", "card", "iban"):
        left = iter(canonical)
        return "".join(next(left) if c.isalnum() else c for c in mention)
    if kind == "person":
        names, mine, own = canonical.split(" "), re.split(r"[ -]", mention.casefold()), re.split(r"[ -]", of)
        if len(mine) < len(own):
            at = next((k for k in range(len(own)) if own[k : k + len(mine)] == mine), 0)
            names = names[at : at + len(mine)]
        marks = [*re.findall(r"[ -]", mention), ""]
        return "".join((x.upper() if mention.isupper() else x.capitalize()) + m for x, m in zip(names, marks, strict=False))
    return canonical.upper() if mention.isupper() and kind == "email" else canonical


def full_names(table: Iterable[tuple[str, str]]) -> frozenset[str]:
    """The persons of (kind, entity) who are known by more than one word."""
    return frozenset(entity for kind, entity in table if kind == "person" and (" " in entity or "-" in entity))


def rewrite(text: str, redrawn: dict[tuple[str, str], str], key: bytes = KEY, names: Container[str] = ()) -> tuple[str, list[str]]:
    """(text with surrogates, kinds of the entities replaced)."""
    out, at, kinds = [], 0, []
    for start, end, kind, canonical in mentions(text, names):
        new = redrawn.get((kind, canonical)) or surrogate(kind, canonical, 0, key)
        out += [text[at:start], render(text[start:end], kind, new, canonical)]
        at = end
        kinds.append(kind)
    return ("".join([*out, text[at:]]), kinds) if kinds else (text, kinds)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        rows = sorted({(k, c, g or "") for text in batch.column("text").to_pylist() if text for *_, k, c, g in found(text)})
        if rows:
            yield pa.RecordBatch.from_pydict({"kind": [x[0] for x in rows], "entity": [x[1] for x in rows], "told": pa.array([x[2] or None for x in rows], pa.string())})


def entity_table(docs: DataFrame, key: bytes = KEY, text: str = "text") -> DataFrame:
    """(kind, entity, told, attempt, surrogate): surrogates that are distinct within a kind and no real entity of the kind.

    told is a person's gender where a title tells it (the smaller letter where titles differ).
    """
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_entities, "kind string, entity string, told string")
    known = materialise(rows.groupBy("kind", "entity").agg(F.min("told").alias("told")), "pii-entities")

    def draw(kinds: pa.Array, entities: pa.Array, attempts: pa.Array, told: pa.Array) -> pa.Array:
        return pa.array([surrogate(k, e, a, key, g) for k, e, a, g in zip(kinds.to_pylist(), entities.to_pylist(), attempts.to_pylist(), told.to_pylist(), strict=True)], pa.string())

    draw.__annotations__ = {"kinds": pa.Array, "entities": pa.Array, "attempts": pa.Array, "told": pa.Array, "return": pa.Array}
    draw = F.arrow_udf(draw, "string")
    drawn = known.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw("kind", "entity", "attempt", "told"))
    real = known.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real")).hint("merge")
    while True:
        drawn = materialise(drawn.select("kind", "entity", "told", "attempt", "surrogate"), "pii-drawn")
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "entity"))
        tested = drawn.withColumn("_place", place).join(real, ["kind", "surrogate"], "left")
        tested = materialise(tested.select("kind", "entity", "told", "attempt", "surrogate", ((F.col("_place") > 1) | F.col("real").isNotNull()).alias("clash")), "pii-tested")
        if tested.filter("clash").isEmpty():
            return tested.drop("clash")
        again = tested.filter("clash").withColumn("attempt", F.col("attempt") + 1)
        drawn = tested.filter("not clash").drop("clash").unionByName(again.select("kind", "entity", "told", "attempt", draw("kind", "entity", "attempt", "told").alias("surrogate")))


def replace(docs: DataFrame, key: bytes = KEY, text: str = "text", plain_table: int = PLAIN_TABLE) -> DataFrame:
    """docs with surrogates in the text column, and pii_kinds, the kinds of the entities that were replaced."""
    needed = "attempt > 0 or told is not null or (kind = 'person' and entity rlike '[ -]')"
    redrawn = entity_table(docs, key, text).filter(needed).select("kind", "entity", "surrogate")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "pii_kinds")]
    some = redrawn.limit(plain_table + 1).collect()
    returns = "struct<text:string,kinds:array<string>>"

    def result(pairs: list[tuple[str | None, list[str]]]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.list_(pa.string()))], ["text", "kinds"])

    if len(some) <= plain_table:
        table = {(r["kind"], r["entity"]): r["surrogate"] for r in some}
        names = full_names(table)
        column = text_udf(lambda texts: result([rewrite(x, table, key, names) if x else (x, []) for x in texts.to_pylist()]), returns)
        out = docs.select(*kept, column(F.col(text)).alias("_new"))
    else:

        def rewrite_all(texts: pa.Array, tables: pa.Array) -> pa.Array:
            known = [{(e["kind"], e["entity"]): e["surrogate"] for e in x or []} for x in tables.to_pylist()]
            return result([rewrite(x, t, key, full_names(t)) if x else (x, []) for x, t in zip(texts.to_pylist(), known, strict=True)])

        rewrite_all.__annotations__ = {"texts": pa.Array, "tables": pa.Array, "return": pa.Array}

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                found = sorted({(i, k, c) for i, x in zip(batch.column("_text_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if x for k, c in [*(m[2:] for m in mentions(x)), *(("person", name) for *_, name in _runs(x, None))]})
                if found:
                    yield pa.RecordBatch.from_pydict({"_text_id": [x[0] for x in found], "kind": [x[1] for x in found], "entity": [x[2] for x in found]})

        marked = docs.withColumn("_text_id", F.sha2(F.col(text), 256))
        of_text = marked.select("_text_id", F.col(text).alias("text")).mapInArrow(named, "_text_id string, kind string, entity string").distinct()
        tables = of_text.join(redrawn, ["kind", "entity"]).groupBy("_text_id").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("_table"))
        out = marked.join(tables, "_text_id", "left").select(*kept, F.arrow_udf(rewrite_all, returns)(F.col(text), F.col("_table")).alias("_new"))
    return out.select(*kept, F.col("_new.text").alias(text), F.col("_new.kinds").alias("pii_kinds"))
