"""Personal data replaced by surrogates (operator 8), DataFrame functions only.

One pattern finds e-mail addresses, telephone numbers, IP addresses, card numbers (whose checksum
holds), account numbers (IBAN), social security numbers, secrets and personal names after a title.
An entity is taken apart into components (local part and domain, given name and family name, ...)
and separators, which stay. Each distinct component gets one surrogate for the whole corpus, drawn
from SHA-512 of a key, its kind, its value and the attempt: the same person, address or domain
stays recognisable (coreference) wherever it occurs. A surrogate has the type and format of
what it replaces: digits for digits, hex for hex, letters of the same script and case (scripts that
``LETTERS`` does not have: Latin letters), names of the same gender (by title) and script, IP addresses
of the reserved block 240/4, card numbers with the same checksum remainder, domains under the
reserved name ``example``, secrets with the same well-known prefix.

The key decides all surrogates, so it must be kept secret; there is no default. The registered query
takes it from ``spark.textmill.pii.key``, else draws one for the run.

Collision checks: a surrogate must differ from every surrogate and every found value of its
kind. Of several components that draw the same one the least value keeps it, the others draw
again with the next attempt, until all are distinct. A format may have too few members for that
(one-letter local parts), or nothing to replace (``_@x.com``): from attempt ``LONGER`` on, and at
once where there is no letter or digit, surrogates are lengthened, by more at each attempt, and
IP addresses are drawn from all there are.

Scale: texts are read once; those with entities (or all, if all are asked for) are written with
their entities and the text between them, so no text is matched or shuffled for the joins. Entities
are made distinct before any join; one that occurs everywhere is a hot key in one join only, with
nothing above it that needs its rows together, so Spark may split it.

Edge cases: a null text stays null; texts without entities come back as they are; rows that
share an id are rows of their own; a null id is an id like any other; an empty table gives an
empty result; all other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.storage import materialize

ATTEMPTS = 40  # lengthened surrogates are distinct long before
LONGER = 3

# Titles that come before a personal name, by gender of the name.
MALE = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Г-н", "Κύριος", "Κύριε"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Doña", "Госпожа", "Г-жа", "Κυρία"]
EITHER = ["Dr", "Prof", "Доктор"]
_TITLES = "|".join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True))
_FIRST = "".join(sorted({t[0] for t in MALE + FEMALE + EITHER}))
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]+"
_LOCAL = r"[\p{L}\p{M}\p{N}_.%+-]"
_LABEL = r"[\p{L}\p{M}\p{N}-]+"

# In order of precedence; no pattern has a capturing group.
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++@{_LABEL}(?:\.{_LABEL})+"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"(?<![\d.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{3,4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
_PREFIX = r"AKIA|gh[pousr]_|sk-"
SECRET = r"\b(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})\b"
PERSON = rf"(?<![\p{{L}}\p{{N}}_])(?:{_TITLES})\.? {_NAME}(?: {_NAME})?"
KINDS = [("email", EMAIL), ("ip", IP), ("iban", IBAN), ("card", CARD), ("ssn", SSN), ("phone", PHONE), ("secret", SECRET), ("person", PERSON)]
PATTERN = "|".join(p for _, p in KINDS)
# What every entity holds, quick to look for: a digit or @, a prefix, hex letters or a title before a capital.
CUES = rf"[0-9@]|(?=[Ags])(?:{_PREFIX})|[a-f]{{32}}|(?=[{_FIRST}])(?:{_TITLES})\.? \p{{Lu}}"

# Syllables of made-up names, by script.
SYLLABLES = {
    "Latin": ["ba", "den", "fol", "gar", "hel", "jo", "kar", "lin", "mar", "nor", "pel", "ral", "sen", "tam", "ver", "wil"],
    "Cyrillic": ["ба", "вел", "гор", "дан", "жо", "зин", "кар", "лин", "мар", "нов", "пел", "рам", "сев", "там", "фед", "хал"],
    "Greek": ["βα", "δεν", "φολ", "γαρ", "ζη", "θεο", "καρ", "λιν", "μαρ", "νορ", "πελ", "ραλ", "σεν", "ταμ", "χρι", "λα"],
}
ENDINGS = {
    "Latin": {"given_m": ["on", "ert", "us", "ric"], "given_f": ["a", "ine", "elle", "ia"], "given_x": ["y", "in", "is", "el"], "family": ["er", "man", "ford", "by"]},
    "Cyrillic": {"given_m": ["ислав", "имир", "ий", "ан"], "given_f": ["а", "ина", "ия", "ея"], "given_x": ["и", "я", "ей", "ал"], "family": ["ский", "енко", "ман", "берг"]},
    "Greek": {"given_m": ["ος", "ης", "ας", "ων"], "given_f": ["α", "η", "ια", "ινη"], "given_x": ["ι", "ω", "υ", "αξ"], "family": ["ιδης", "ακης", "οπουλος", "ου"]},
}
# Letters of the same kind, by the class of what they replace; the first class that fits holds.
LETTERS = [
    (r"^[0-9]$", "0123456789"),
    (r"^[a-z]$", "abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z]$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^(?=\p{IsLatin})\p{Ll}$", "àáâãäåçèéêëìíîïñòóôõöøùúûüý"),
    (r"^(?=\p{IsLatin})\p{Lu}$", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"),
    (r"^(?=\p{IsCyrillic})\p{Lu}$", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"^\p{IsCyrillic}$", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"^(?=\p{IsGreek})\p{Lu}$", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"^\p{IsGreek}$", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"^\p{IsArmenian}$", "աբգդեզէթժիլխծկհձղճմյնշ"),
    (r"^\p{IsHebrew}$", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"^\p{IsArabic}$", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"^\p{IsDevanagari}$", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"),
    (r"^\p{IsThai}$", "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวศสห"),
    (r"^\p{IsHiragana}$", "あいうえおかきくけこさしすせそたちつてとなにぬねの"),
    (r"^\p{IsKatakana}$", "アイウエオカキクケコサシスセソタチツテトナニヌネノ"),
    (r"^\p{IsHangul}$", "가나다라마바사아자차카타파하고노도로모보소오조초"),
    (r"^\p{IsHan}$", "中大小山川田王李林高石木水火土金月日文天"),
    (r"^\p{Lu}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^\p{L}$", "abcdefghijklmnopqrstuvwxyz"),
    (r"^\p{Nd}$", "0123456789"),
]


def matches(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind_of(entity: Column) -> Column:
    """The kind of a match; that of a card number without a valid checksum is "none"."""
    out = F.lit("person")
    for kind, pattern in reversed(KINDS[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return F.when((out == "card") & (_checksum(F.regexp_replace(entity, r"\D", "")) != 0), "none").otherwise(out)


def _part(kind: str | Column, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def components(kind: Column, entity: Column) -> Column:
    """The entity as an array of (kind, value); the kind "keep" is left as it is."""
    domain = F.substring_index(entity, "@", -1)
    email = F.array(_part("email_local", F.substring_index(entity, "@", 1)), _part("keep", F.lit("@")), _part("email_domain", domain))
    words = F.split(entity, " ")
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(title.isin(MALE), "given_m").when(title.isin(FEMALE), "given_f").otherwise("given_x")
    given = F.array(_part(gender, F.get(words, 1)), _part("keep", F.lit(" ")))
    family = F.array(_part("family", F.element_at(words, -1)))
    person = F.concat(F.array(_part("keep", F.concat(words[0], F.lit(" ")))), F.when(F.size(words) > 2, F.concat(given, family)).otherwise(family))
    return F.when(kind == "email", email).when(kind == "person", person).when(kind == "none", F.array(_part("keep", entity))).otherwise(F.array(_part(kind, entity)))


def _stream(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """Pseudo-random hex digits, at least two for each character of ``value``."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt)), i.cast("string")), 512)), "")


def _number(stream: Column, i: Column, below: int) -> Column:
    """A number below ``below`` from the i-th byte of the stream."""
    return F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % below


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n + 1, F.lit(1))


def _like(value: Column, stream: Column, hexadecimal: Column) -> Column:
    """Every letter and digit replaced by one of its class; other characters stay."""

    def one(i: Column) -> Column:
        c = F.substring(value, i + 1, F.lit(1))
        out = F.when(hexadecimal & F.rlike(c, F.lit("^[0-9a-f]$")), _letter("0123456789abcdef", _number(stream, i, 16)))
        for of, letters in LETTERS:
            out = out.when(F.rlike(c, F.lit(of)), _letter(letters, _number(stream, i, len(letters))))
        return out.otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def _checksum(digits: Column) -> Column:
    """Luhn sum, modulo 10, of a string of digits."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0), lambda a, x: a + x) % 10


def _name(kind: Column, value: Column, stream: Column, like: Column, attempt: int) -> Column:
    """A made-up name of the script and gender; later attempts have more syllables. Other scripts: ``like``."""
    out = like
    for script, parts in SYLLABLES.items():
        syllables = F.array(*(F.lit(s) for s in parts))
        body = F.concat(*(F.element_at(syllables, _number(stream, F.lit(i), 16) + 1) for i in range(2 + attempt)))
        ending = F.lit("")
        for k, choices in ENDINGS[script].items():
            ending = F.when(kind == k, F.element_at(F.array(*(F.lit(c) for c in choices)), _number(stream, F.lit(50), 4) + 1)).otherwise(ending)
        name = F.concat(body, ending)
        out = F.when(value.rlike(rf"^\p{{Is{script}}}"), F.when(value.rlike(r"\p{Ll}"), F.initcap(name)).otherwise(F.upper(name))).otherwise(out)
    return out


def _lengthened(key: str, kind: Column, value: Column, like: Column, attempt: int) -> Column:
    """``like`` with characters added, digits where it has no letters, if its format may be exhausted."""
    more = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("longer"), kind, value, F.lit(str(attempt))), 512), 1, 2 * max(attempt - LONGER, 0) + 4)
    more = F.when(kind.isin("card", "ssn", "phone"), F.translate(more, "abcdef", "012345")).when(kind == "iban", F.upper(more)).otherwise(more)
    return F.concat(like, more) if attempt >= LONGER else F.when(value.rlike(r"[0-9\p{L}]"), like).otherwise(F.concat(like, more))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def surrogate(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """What replaces a component at this attempt."""
    hexadecimal = (kind == "secret") & value.rlike("^[0-9a-f]+$")
    like = lambda stream: _let(_like(value, stream, hexadecimal), lambda x: _formed(key, kind, value, stream, x, attempt))
    return _let(_stream(key, kind, value, attempt), like)


def _formed(key: str, kind: Column, value: Column, stream: Column, like: Column, attempt: int) -> Column:
    """``like`` brought into the form of its kind."""
    first = F.lit(240) + _number(stream, F.lit(0), 15) if attempt < LONGER else _number(stream, F.lit(0), 256)
    ip = F.concat_ws(".", first.cast("string"), *(_number(stream, F.lit(i), 256).cast("string") for i in (1, 2, 3)))
    labels = F.regexp_replace(like, r"\.[^.]*$", "")
    labels = F.when(F.length(F.regexp_replace(labels, r"[^\p{L}\p{N}]", "")) < 4, F.concat(labels, F.substring(stream, 20, 4))).otherwise(labels)
    domain = F.concat(_lengthened(key, kind, value, labels, attempt), F.lit(".example"))
    after = lambda start: F.concat(start, F.substring(like, F.length(start) + 1, F.length(like)))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    change = F.pmod(_checksum(digits(value)) - _checksum(digits(like)), F.lit(10))
    last = F.pmod(F.substring(like, -1, 1).cast("int") + change, F.lit(10)).cast("string")
    card = F.concat(F.substring(like, F.lit(1), F.length(like) - 1), last)
    formed = (
        F.when(kind == "phone", after(F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|\+\d)", 1)))
        .when(kind == "iban", after(F.substring(value, 1, 2)))
        .when(kind == "secret", after(F.regexp_extract(value, f"^({_PREFIX})", 1)))
        .when(kind == "card", card)
        .otherwise(like)
    )
    named = kind.isin("given_m", "given_f", "given_x", "family")
    return F.when(named, _name(kind, value, stream, like, attempt)).when(kind == "ip", ip).when(kind == "email_domain", domain).otherwise(_lengthened(key, kind, value, formed, attempt))


def resolve(parts: DataFrame, key: str, draw=surrogate) -> DataFrame:
    """Distinct ``parts`` (kind, value) -> (kind, value, surrogate), distinct within each kind."""
    given = parts.select("kind", F.col("value").alias("surrogate"))
    left, done = parts, None
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work
    for attempt in range(ATTEMPTS):
        drawn = (left.repartition(tasks) if attempt == 0 else left).withColumn("surrogate", draw(key, F.col("kind"), F.col("value"), attempt))
        taken = given if done is None else given.unionByName(done.select("kind", "surrogate"))
        keeps = drawn.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        new = materialize(keeps.select("kind", "value", "surrogate"), f"surrogates-{attempt}")
        done = new if done is None else done.unionByName(new)
        left = materialize(left.join(new, ["kind", "value"], "left_anti"), f"surrogates-left-{attempt}")
        if left.isEmpty():
            return done
    raise RuntimeError(f"surrogates not distinct after {ATTEMPTS} attempts")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct ``entities`` (entity) -> (entity, kind, surrogate)."""
    apart = entities.select("entity", kind_of(F.col("entity")).alias("entity_kind")).select("entity", "entity_kind", F.posexplode(components(F.col("entity_kind"), F.col("entity"))).alias("pos", "part"))
    apart = materialize(apart.select("entity", "entity_kind", "pos", "part.kind", "part.value"), "entity-parts")
    named = resolve(materialize(apart.where("kind <> 'keep'").select("kind", "value").distinct(), "components"), key)
    pieces = apart.join(named, ["kind", "value"], "left").groupBy("entity", "entity_kind").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("surrogate", "value").alias("s")))).alias("p"))
    return pieces.select("entity", F.col("entity_kind").alias("kind"), F.array_join(F.col("p.s"), "").alias("surrogate"))


def pseudonymize(docs: DataFrame, key: str, only_changed: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with every entity in ``text`` replaced. With ``only_changed`` the result
    is a row for each document with entities: doc_id, n_entities, kinds and the new text."""
    text = F.col("text").cast("string")
    # As one array element, so that the pattern is not matched again by a filter or another column.
    cut = F.transform(F.array(F.when(text.rlike(CUES), text)), lambda t: F.struct(matches(t).alias("hits"), t.alias("text")))
    cut = F.transform(cut, lambda x: F.when(F.size(x["hits"]) > 0, F.struct(x["hits"].alias("hits"), F.split(x["text"], PATTERN, -1).alias("gaps"))))
    kept = F.filter(cut, lambda x: x.isNotNull()) if only_changed else cut
    row = F.struct(*(F.col(f"`{c}`") for c in (["doc_id"] if only_changed else docs.columns)))
    rows = materialize(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("place"), F.explode(kept).alias("cut")), "entity-rows")
    found = rows.select("place", F.posexplode("cut.hits").alias("at", "entity"))
    named = materialize(surrogates(materialize(found.select("entity").distinct(), "entities"), key), "entity-surrogates")
    given = found.join(named, "entity").select("place", F.struct("at", "surrogate", "kind").alias("s"))
    per_row = given.groupBy("place").agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.col("place").alias("of"), "s")
    changed = F.filter("s", lambda x: x["kind"] != "none")
    gaps = F.col("cut.gaps")
    rewritten = F.concat(F.array_join(F.transform("s", lambda x, i: F.concat(F.get(gaps, i), x["surrogate"])), ""), F.element_at(gaps, -1))
    if only_changed:
        kinds = F.array_join(F.array_sort(F.array_distinct(changed["kind"])), ",")
        return rows.join(per_row, F.col("place") == F.col("of")).where(F.size(changed) > 0).select("row.doc_id", F.size(changed).alias("n_entities"), kinds.alias("kinds"), rewritten.alias("text"))
    out = F.when(F.col("s").isNull(), F.col("row.text").cast("string")).otherwise(rewritten)
    return rows.join(per_row, F.col("place") == F.col("of"), "left").select(*((out if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
