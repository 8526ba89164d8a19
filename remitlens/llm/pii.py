"""Personal data replaced by keyed surrogates, with Spark SQL functions only.

Detected entities get replacements of the same type and format: digits for digits, letters for
letters of the same case, octets of the same length, valid check digits where the original has
one, names of the same gender and script. A surrogate follows from the key and the canonical
form of the entity, so every spelling and every document gets the same one (coreference). The
distinct entities of the corpus are then checked: where two would share a surrogate, or a
surrogate is itself an entity of the corpus, all but one draw again until all are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import materialize

KEY = "surrogate key"
#: Draws for one entity before its format is widened, once more after each so many further ones;
#: only formats with few forms, or with as many entities as forms, ever need it.
WIDEN_AFTER = 6
MAX_ROUNDS = 40

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"

#: Type and pattern; where several match at one place the first wins.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "man": rf"(?<!\p{{L}})(?:{MALE})\.? {_NAME}(?: {_NAME})?",
    "woman": rf"(?<!\p{{L}})(?:{FEMALE})\.? {_NAME}(?: {_NAME})?",
}
ENTITY = "|".join(PATTERNS.values())
#: A text without any of these has no entity; a far cheaper test.
HINT = rf"[@0-9]|AKIA|gh[pousr]_|(?:{MALE}|{FEMALE})\.? \p{{Lu}}"

#: Given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("man", "latin"): "Adrian Bruno Conrad Dario Emil Felix Gabriel Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Ralf Simon Tobias Viktor",
    ("woman", "latin"): "Anna Berta Clara Daria Elena Flora Greta Helena Ida Julia Karla Lena Maria Nora Olga Paula Rosa Sofia Tina Vera",
    ("man", "cyrillic"): "Адам Борис Виктор Глеб Денис Егор Игорь Лев Марк Олег",
    ("woman", "cyrillic"): "Анна Вера Дарья Елена Зоя Инна Лидия Мария Нина Ольга",
    ("man", "greek"): "Αλέξης Γιάννης Δήμος Ηλίας Κώστας Λουκάς Μάνος Νίκος Πέτρος Σπύρος",
    ("woman", "greek"): "Άννα Βάσω Δάφνη Ελένη Ζωή Ηρώ Λίνα Μαρία Νίκη Σοφία",
}
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo",
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во",
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το",
}


def kind(entity: Column) -> Column:
    """The type of a detected string."""
    first = entity.substr(1, 1)
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})$"), "key")
        .when(entity.rlike("^[0-9A-Fa-f]{40}$"), "secret")
        .when(first == "+", "phone")
        .when(entity.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(entity.rlike(r"^[0-9]{1,3}\."), "ip")
        .when(first.between("0", "9"), "card")
        .when(entity.rlike(rf"^(?:{MALE})\.? "), "man")
        .otherwise("woman")
    )


def canonical(type_: Column, entity: Column) -> Column:
    """What all spellings of one entity share."""
    name = F.lower(F.regexp_replace(entity, rf"^(?:{MALE}|{FEMALE})\.? ", ""))
    return (
        F.when(type_.isin("phone", "card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(type_ == "iban", F.regexp_replace(entity, " ", ""))
        .when(type_.isin("email", "secret"), F.lower(entity))
        .when(type_.isin("man", "woman"), name)
        .otherwise(entity)
    )


def _digest(key: str, type_: Column, name: Column, attempt: Column) -> Column:
    """128 keyed hex digits, repeated for long names."""
    return F.repeat(F.sha2(F.concat_ws("\x1f", F.lit(key), type_, name, attempt.cast("string")), 512), 4)


def _number(hexed: Column, at: int | Column, low: int, size: int) -> Column:
    """A keyed number in low..low + size - 1 from four hex digits."""
    start = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(hexed, start, F.lit(4)), 16, 10).cast("int") % size + low


def _letters(hexed: Column, name: Column, keep: int | Column = 0) -> Column:
    """Every digit and letter but the first ``keep`` changed to one of its own kind."""
    kept = keep if isinstance(keep, Column) else F.lit(keep)

    def swap(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(hexed, (2 * i) % 500 + 1, F.lit(2)), 16, 10).cast("int")
        return (
            F.when(i < kept, c)
            .when(c.between("0", "9"), (n % 10).cast("string"))
            .when(c.between("a", "z"), F.char(n % 26 + 97))
            .when(c.between("A", "Z"), F.char(n % 26 + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(name, ""), swap), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the last but one doubled and folded."""
    reverse = F.reverse(F.split(digits, ""))

    weighed = F.transform(
        reverse,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(weighed, F.lit(0), lambda total, x: total + x)


def _card(hexed: Column, name: Column) -> Column:
    """First digit kept; valid by the Luhn sum if, and only if, the original is."""
    body = F.concat(_letters(hexed, F.left(name, F.length(name) - 1), 1), F.lit("0"))
    valid = (10 - _luhn_sum(body) % 10) % 10
    check = F.when(_luhn_sum(name) % 10 == 0, valid).otherwise((valid + 1) % 10)
    return F.concat(F.left(body, F.length(body) - 1), check.cast("string"))


def _ip(hexed: Column, name: Column, attempt: Column) -> Column:
    """Octets of the same lengths; any length once that format proves too small."""

    def octet(part: Column, i: Column) -> Column:
        at = 4 * i + 1
        size = F.length(part)
        return (
            F.when(attempt >= WIDEN_AFTER, _number(hexed, at, 1, 254))
            .when(size == 1, _number(hexed, at, 1, 9))
            .when(size == 2, _number(hexed, at, 10, 90))
            .otherwise(_number(hexed, at, 100, 156))
            .cast("string")
        )

    return F.array_join(F.transform(F.split(name, r"\."), octet), ".")


def _pick(listed: str, hexed: Column, at: int | Column) -> Column:
    words = listed.split()
    return F.element_at(F.array(*(F.lit(w) for w in words)), _number(hexed, at, 1, len(words)))


def _invented(listed: str, hexed: Column, size: Column) -> Column:
    """A word of so many keyed syllables."""
    parts = F.transform(F.sequence(F.lit(1), size), lambda i: _pick(listed, hexed, 4 * i + 1))
    return F.array_join(parts, "")


def _wider(hexed: Column, attempt: Column, size: int, digits: bool = False) -> Column:
    """Keyed letters or digits to add to a form, ``size`` per widening; none at first."""
    count = F.call_function("div", attempt, F.lit(WIDEN_AFTER)).cast("int") * size
    pool = F.translate(F.substring(hexed, 129, 128), "0123456789", "ghijklmnop")
    if digits:
        pool = F.translate(F.substring(hexed, 129, 128), "abcdef", "012345")
    return F.left(pool, count)


def _person(hexed: Column, type_: Column, name: Column, attempt: Column) -> Column:
    """A given name of the gender, if there were two words, and an invented family name.

    Family names grow by syllables when widened.
    """
    more = F.call_function("div", attempt, F.lit(WIDEN_AFTER)).cast("int")
    script = (
        F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic")
        .when(name.rlike(r"\p{IsGreek}"), "greek")
        .otherwise("latin")
    )
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (gender, letters), listed in GIVEN.items():
        given = F.when((type_ == gender) & (script == letters), _pick(listed, hexed, 1)).otherwise(given)
    for letters, listed in SYLLABLES.items():
        built = F.initcap(_invented(listed, hexed, 4 + 2 * more))
        family = F.when(script == letters, built).otherwise(family)
    return F.when(name.contains(" "), F.concat_ws(" ", given, family)).otherwise(family)


def surrogate(key: str, type_: Column, name: Column, attempt: Column) -> Column:
    """The replacement of a canonical form, itself in canonical form (names keep their case)."""
    hexed = _digest(key, type_, name, attempt)
    ending = F.length(name) - F.length(F.substring_index(name, ".", -1))
    email = F.concat(
        _wider(hexed, attempt, 4), _letters(hexed, F.left(name, ending)), F.substring_index(name, ".", -1)
    )
    more_digits = _wider(hexed, attempt, 3, digits=True)
    kept = F.when(F.length(name) > 10, F.length(name) - 10).otherwise(1)
    return (
        F.when(type_ == "email", email)
        .when(type_ == "key", _letters(hexed, name, 4))
        .when(type_ == "secret", F.left(hexed, F.length(name)))
        .when(type_ == "iban", _letters(hexed, name, 2))
        .when(type_ == "phone", F.concat(_letters(hexed, name, kept), more_digits))
        .when(type_ == "card", _card(hexed, name))
        .when(type_ == "ip", _ip(hexed, name, attempt))
        .when(type_ == "ssn", F.concat(_letters(hexed, name), more_digits))
        .otherwise(_person(hexed, type_, name, attempt))
    )


def in_format(entity: Column, type_: Column, drawn: Column) -> Column:
    """The drawn canonical form written as the entity is: its separators, its title, its case."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def fill(state: Column, c: Column) -> Column:
        solid = c.rlike("[0-9A-Za-z]")
        return F.struct(
            F.concat(state["s"], F.when(solid, F.substring(drawn, state["k"], F.lit(1))).otherwise(c)).alias("s"),
            (state["k"] + solid.cast("int")).alias("k"),
        )

    whole = lambda s: F.concat(s["s"], F.substr(drawn, s["k"]))  # noqa: E731 - a widened form is longer
    written = F.aggregate(F.split(entity, ""), start, fill, whole)
    title = F.regexp_extract(entity, rf"^(?:{MALE}|{FEMALE})\.? ", 0)
    return (
        F.when(type_.isin("phone", "card", "ssn", "iban"), written)
        .when(type_.isin("man", "woman"), F.concat(title, drawn))
        .when(type_.isin("email", "secret") & (entity == F.upper(entity)), F.upper(drawn))
        .otherwise(drawn)
    )


def distinct_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """type, name, drawn for each distinct (type, name): all drawn forms differ, and none is
    itself an entity of that type.

    Raises RuntimeError when draws still collide after ``MAX_ROUNDS``.
    """
    names = materialize(entities.select("type", "name").distinct(), "entities")
    real = names.select("type", F.col("name").alias("drawn"))
    draw = lambda df: df.withColumn(
        "drawn", surrogate(key, F.col("type"), F.col("name"), F.col("attempt"))
    )
    table = draw(names.withColumn("attempt", F.lit(0)))
    for _ in range(MAX_ROUNDS):
        table = materialize(table, "drawn")
        taken = real.withColumn("taken", F.lit(True))
        # the entity least often redrawn, then the least by name, keeps what several drew
        first = table.groupBy("type", F.lower("drawn").alias("low")).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("name", F.struct(-F.col("attempt"), "name")).alias("owner")
        )
        clash = materialize(
            first.where("n > 1")
            .select("type", "low", "owner")
            .unionByName(
                table.select("type", F.lower("drawn").alias("low"))
                .join(taken.select("type", F.lower("drawn").alias("low")), ["type", "low"], "left_semi")
                .select("type", "low", F.lit(None).cast("string").alias("owner"))
            )
            .groupBy("type", "low")
            .agg(F.when(F.count("owner") == F.count(F.lit(1)), F.min("owner")).alias("owner")),
            "clash",
        )
        if clash.isEmpty():
            return table
        marked = table.withColumn("low", F.lower("drawn")).join(
            clash.withColumn("hit", F.lit(True)), ["type", "low"], "left"
        )
        lost = F.col("hit").isNotNull() & ~F.col("owner").eqNullSafe(F.col("name"))
        table = draw(
            marked.withColumn("attempt", F.col("attempt") + lost.cast("int")).select("type", "name", "attempt")
        )
    raise RuntimeError("surrogates still collide; the formats found are too small")


def replace_personal_data(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of ``docs``, text with surrogates, and ``n_replaced``.

    Null and empty texts stay as they are with n_replaced 0, as does any text without an
    entity; only texts with one are written and joined. Repeated rows are all replaced, null
    ids make no difference, other columns pass through whatever their names; one called n_replaced
    is replaced.
    """
    columns = [c for c in docs.columns if c != "n_replaced"]
    docs = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_given"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ENTITY), F.lit(False))
    plain = docs.where(~has).withColumn("n_replaced", F.lit(0))
    found = materialize(
        docs.where(has).withColumn("_row", F.monotonically_increasing_id()), "with_entities"
    )
    listed = found.select(
        "_row", F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("at", "entity")
    )
    named = listed.withColumn("type", kind(F.col("entity"))).withColumn(
        "name", canonical(F.col("type"), F.col("entity"))
    )
    drawn = distinct_surrogates(named, key).select("type", "name", "drawn")
    written = (
        named.join(drawn, ["type", "name"])
        .select("_row", "at", in_format(F.col("entity"), F.col("type"), F.col("drawn")).alias("new"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_new"))
    )
    between = F.split("text", ENTITY, -1)
    text = F.concat(
        F.element_at(between, 1),
        F.array_join(
            F.zip_with(
                F.transform("_new", lambda x: x["new"]),
                F.slice(between, 2, F.greatest(F.size("_new"), F.lit(1))),
                lambda new, behind: F.concat(new, behind),
            ),
            "",
        ),
    )
    changed = found.join(written, "_row").withColumns(
        {"n_replaced": F.size("_new"), "text": text}
    )
    names = [F.col("text") if c == "text" else F.col(f"_given.`{c}`") for c in columns]
    both = [part.select(*names, "n_replaced") for part in (plain, changed)]
    return reduce(DataFrame.unionByName, both)
