"""Personal data: keyed surrogates of the same type, gender, script and format, in SQL functions only.

Entities are found by one pattern. Each distinct atom (an address, a number, a name part) gets one
surrogate for the whole corpus, so mentions of the same thing stay mentions of the same thing. Surrogates
that equal another one or a real value are drawn again until all are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmill.llm.table import ROW, staged

# Names to recognise and to draw from, by script and gender.
GIVEN = {
    ("latin", "f"): "Mary Anna Emma Laura Julia Sarah Elena Sophie Marie Clara Lucia Carmen Ingrid Helga Monique Claire Isabel Teresa Alice Nora Eva Ruth".split(),
    ("latin", "m"): "John James Peter Paul Thomas Michael David Robert Hans Karl Jean Pierre Jacques Carlos Juan Pedro Miguel Antonio Martin Oscar Hugo Felix".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Владимир Михаил Андрей Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος".split(),
}
SYLLABLES = {
    "latin": "ba ber bor dal den dor fel fen gar hol ker kin lan lar mar mel nor pel ran ris sel son tal tor val ver wen wil".split(),
    "cyrillic": "бар вол гор дан зим кар лес мир нов пет рад сел тур хар чер шар".split(),
    "greek": "βαρ γαλ δημ καρ λαμ μαν νικ παπ σαρ ταρ φιλ χαρ".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Госпожа Κυρία".split(), "m": "Mr Sir Herr Monsieur Señor Sr Don Господин Κύριος".split(), "any": "Dr Prof Doctor Professor".split()}
SECRET_WORDS = "token api[_-]?key secret password passwd access[_-]?key".split()

_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_GIVEN = "|".join(name for names in GIVEN.values() for name in names)
_HEX = "[0-9A-Fa-f]{1,4}"
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
#: The kinds in the order in which they are tried at a position. Tests of one character come before the
#: costly looks behind that imply them.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?<=[=: \"'])(?=[A-Za-z0-9_+/-]{{12}})(?<=(?i:{'|'.join(SECRET_WORDS)}) {{0,3}}[=:] {{0,3}}[\"']?)[A-Za-z0-9_+/-]{{12,}}|(?<!\w)[0-9a-fA-F]{{32,}}(?!\w)",
    "ipv6": rf"(?<![\w:])(?=[0-9A-Fa-f]{{0,4}}:)(?:(?:{_HEX}:){{7}}{_HEX}|(?=:*[0-9A-Fa-f])(?!(?:[0-9A-Fa-f]*:){{9}})(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?(?:(?<=:\d{{1,3}})(?:\.\d{{1,3}}){{3}})?)(?![\w:])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+])\d(?:[ -]?\d){12,18}(?!\w)",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)",
    "person": rf"(?=\p{{Lu}})(?:(?<= )(?<=(?<!\p{{L}})(?:{_TITLE})\.? )(?!(?:{_TITLE})(?!\p{{L}})){_NAME}(?: {_NAME})?|(?<!\p{{L}})(?:{_GIVEN}) {_NAME})",
}
#: No kind begins right after a letter, so most places are passed over at once.
ANY = f"(?<![A-Za-z])(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})"


def _matches(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{PATTERNS[kind]})$")


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _atoms(match: Column) -> Column:
    """What a match consists of: an array of (kind, value) that is joined by spaces."""
    shape = {
        "email": match.contains("@"), "ip": _matches(match, "ip"), "ipv6": _matches(match, "ipv6"), "ssn": _matches(match, "ssn"),
        "card": _matches(match, "card"), "phone": match.rlike(r"^[+(\d][\d() .+-]*$"), "iban": _matches(match, "iban"),
    }
    kind = reduce(lambda rest, name: F.when(shape[name], name).otherwise(rest), reversed(shape), F.lit("secret"))
    person = match.rlike(rf"^{_NAME}(?: {_NAME})?$") & ~match.rlike("^[0-9A-Fa-f]{12,}$")
    part = lambda t: F.struct(_name_kind(t).alias("kind"), t.alias("value"))
    return F.when(person, F.transform(F.split(match, " "), part)).otherwise(F.array(F.struct(kind.alias("kind"), match.alias("value"))))


def _name_kind(part: Column) -> Column:
    """Given names have a gender, any other name part is a family name."""
    kind = F.lit("family")
    for gender in "fm":
        kind = F.when(part.isin(*[n for (_, g), names in GIVEN.items() if g == gender for n in names]), f"given_{gender}").otherwise(kind)
    return kind


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Hex digits drawn from the key, the atom and the attempt: two or more bytes for every character."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 16).cast("int") + 1)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 256)), "")


def _characters(value: Column, stream: Column, keep: Column, hexadecimal: Column) -> Column:
    """Another character of the same class at every place but the first ``keep``; signs stay."""
    def change(c, i):
        n = _byte(stream, i)
        pick = lambda letters: F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))
        return (
            F.when(i < keep, c).when(c.rlike("[0-9]") & ~hexadecimal, pick("0123456789"))
            .when(hexadecimal & c.rlike("[0-9a-f]"), pick("0123456789abcdef")).when(hexadecimal & c.rlike("[A-F]"), pick("ABCDEF"))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), change), "")


def _luhn(value: Column) -> Column:
    """Luhn sum of the digits, the last one counting once."""
    digits = F.reverse(F.split(F.regexp_replace(value, r"\D", ""), ""))
    twice = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(digits, twice), F.lit(0), lambda a, d: a + d)


def _card(value: Column, stream: Column) -> Column:
    """First digit and layout stay; a valid check digit stays valid."""
    drawn = _characters(value, stream, F.lit(1), F.lit(False))
    head = F.regexp_replace(drawn, r"\d$", "")
    check = F.concat(head, F.pmod(10 - _luhn(F.concat(head, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return F.when(_luhn(value) % 10 == 0, check).otherwise(drawn)


def _iban(value: Column, stream: Column) -> Column:
    """Country and layout stay, the check digits fit the drawn account."""
    drawn = _characters(value, stream, F.lit(4), F.lit(False))
    turned = F.concat(F.regexp_replace(F.substring(drawn, F.lit(5), F.length(drawn)), " ", ""), F.substring(drawn, 1, 2), F.lit("00"))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97
    ).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(F.substring(drawn, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(drawn, F.lit(5), F.length(drawn)))


def _ip(value: Column, stream: Column) -> Column:
    """Every number keeps its count of digits and stays below 256."""
    part = lambda o, i: F.element_at(F.array(
        (_byte(stream, i) % 10).cast("string"), (_byte(stream, i) % 90 + 10).cast("string"), (_byte(stream, i) % 156 + 100).cast("string")), F.length(o))
    return F.array_join(F.transform(F.split(value, r"\."), part), ".")


def _ipv6(value: Column, stream: Column) -> Column:
    """Groups keep their lengths and "::" its place; numbers of a dotted end stay below 256."""
    groups = _characters(F.regexp_replace(value, r"[0-9]+(?:\.[0-9]+){3}$", ""), stream, F.lit(0), F.lit(True))
    return F.when(value.contains("."), F.concat(groups, _ip(F.regexp_extract(value, r"([0-9.]+)$", 1), stream))).otherwise(groups)


def _email(value: Column, stream: Column) -> Column:
    """The top domain stays."""
    top = F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)
    return F.concat(_characters(F.regexp_replace(value, r"\.[A-Za-z]+$", ""), stream, F.lit(0), F.lit(False)), top)


def _name(value: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    """A name of the same script and gender; later attempts draw double names."""
    def part(words, i):
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(_byte(stream, 2 * i) * 256 + _byte(stream, 2 * i + 1), F.lit(len(words))) + 1).cast("int"))

    def of(script):
        parts = F.sequence(F.lit(0), F.floor(attempt / 4).cast("int"))
        given = {g: F.array_join(F.transform(parts, lambda i: part(GIVEN[script, g], i)), "-") for g in "fm"}  # noqa: B023
        syllables = F.sequence(F.lit(0), 2 + F.floor(attempt / 4).cast("int"))
        family = F.initcap(F.array_join(F.transform(syllables, lambda i: part(SYLLABLES[script], i)), ""))
        return F.when(kind == "given_f", given["f"]).when(kind == "given_m", given["m"]).otherwise(family)

    script = _script(value)
    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def _surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    stream = _stream(key, kind, value, attempt)
    plain = _characters(value, stream, F.lit(0), F.lit(False))
    drawn = (
        F.when(kind == "email", _email(value, stream)).when(kind == "ip", _ip(value, stream)).when(kind == "card", _card(value, stream))
        .when(kind == "ipv6", _ipv6(value, stream))
        .when(kind == "iban", _iban(value, stream)).when(kind == "phone", _characters(value, stream, F.length(F.regexp_extract(value, r"^(\+\d{1,3})", 1)), F.lit(False)))
        .when(kind.isin("given_f", "given_m", "family"), _name(value, kind, stream, attempt))
        .when(value.rlike("^[0-9a-f:]+$") | value.rlike("^[0-9A-F:]+$"), _characters(value, stream, F.lit(0), F.lit(True))).otherwise(plain)
    )
    # a format with hardly any free values left gets longer
    return F.when((attempt >= 20) & (kind != "family"), F.concat(drawn, F.substring(F.conv(F.substring(stream, 1, 12), 16, 10), F.lit(1), attempt - 19))).otherwise(drawn)


def mapping(atoms: DataFrame, key: str) -> DataFrame:
    """Staged ``kind, value, surrogate`` of distinct atoms; no surrogate is repeated or equals a real value."""
    table = staged(atoms.select("kind", "value").distinct().select("kind", "value", F.lit(0).alias("attempt")), "pii-atoms")
    real = table.select(F.col("value").alias("surrogate")).distinct()
    attempt = F.col("attempt")
    while True:
        table = staged(table.select("kind", "value", "attempt", _surrogate(key, F.col("kind"), F.col("value"), attempt).alias("surrogate")), "pii-surrogates")
        owners = table.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("owner"))
        taken = real.join(owners, "surrogate", "left_semi").select("surrogate", F.lit(True).alias("real"))
        checked = table.join(owners.join(taken, "surrogate", "left"), "surrogate")
        again = F.col("real").isNotNull() | (F.struct("attempt", "kind", "value") != F.col("owner"))
        checked = staged(checked.select("kind", "value", (attempt + again.cast("int")).alias("attempt"), "surrogate", again.alias("again")), "pii-checked")
        if not checked.where("again").head(1):
            return checked.select("kind", "value", "surrogate")
        table = checked.select("kind", "value", "attempt")


def surrogates(docs: DataFrame, *, key: str = "corpus", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with the entities of ``text_col`` replaced, plus the staged mapping of atoms.

    Rows, their order of columns and all other columns stay; a last column ``n_entities`` is added. A null
    text stays null and an empty one empty (0 entities). ``key`` decides the surrogates: the same key and
    corpus give the same ones. Titles, separators, country codes, top domains and check digits are kept.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    found = plain.withColumn("_matches", F.coalesce(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), F.array().cast("array<string>")))
    rows = staged(found.withColumn(ROW, F.monotonically_increasing_id()), "pii-rows")
    hits = rows.where(F.size("_matches") > 0)
    atoms = hits.select(ROW, F.explode(F.array_distinct(F.flatten(F.transform("_matches", _atoms)))).alias("a")).select(ROW, "a.kind", "a.value")
    atoms = staged(atoms, "pii-mentions")
    table = mapping(atoms, key)
    by_row = atoms.join(table, ["kind", "value"]).groupBy(ROW).agg(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "value"), "surrogate")).alias("pairs"))
    parts = lambda m, new: F.array_join(F.transform(_atoms(m), lambda a: new[F.concat_ws("\x1f", a["kind"], a["value"])]), " ")
    changed = hits.join(by_row, ROW).withColumn("_new", F.map_from_entries("pairs"))
    gaps = F.split(F.col(text), ANY, -1)
    inserted = F.concat(F.transform("_matches", lambda m: parts(m, F.col("_new"))), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(gaps, inserted, lambda g, s: F.concat(g, s)), "")
    columns = [whole if c == text else F.col(c) for c in plain.columns]
    changed = changed.select(*[c.alias(n) for c, n in zip(columns, plain.columns)], F.size("_matches").alias("n"))
    kept = rows.where(F.size("_matches") == 0).select(*plain.columns, F.lit(0).alias("n"))
    return changed.unionByName(kept).toDF(*names, "n_entities"), table
