"""Keyed surrogates for personal data, with DataFrame functions only.

Entities are found by pattern: e-mail addresses, phone, card and identity numbers, IP addresses,
IBANs, and name parts behind a title. Each is reduced to what it identifies (the lower-cased
address, the digits, the lower-cased name; behind a title the first of several name parts is the
given name, and its gender is that of all its titles), and that is replaced by something of the same type
drawn from a keyed hash: digits by digits, letters by letters of the same script and case, a Luhn
number by a Luhn number, an IBAN by one whose check digits hold, an address octet by an octet, a given name by one of the same gender and a
family name by a made-up one. All mentions of an entity get one surrogate, written in each
mention's own format.

Two entities never share a surrogate, and no surrogate is itself a real entity of the corpus:
collisions are looked for among all entities, the least entity keeps the surrogate and the others
draw again, until there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

# Titles by gender, and given names to draw from
_MALE_TITLES, _FEMALE_TITLES, _OTHER_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Sir|Don", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña", "Dr|Prof|Doktor|Professor|Doctor"
_MALE = "Adam Adrian Alan Albert Andre Anton Arthur Axel Ben Boris Bruno Carl Cedric Daniel David Dennis Dominic Eduard Elias Emil Eric Felix Fabian Frank Gabriel Georg Gregor Hector Henry Hugo Ivan Jacob Jonas Julian Karl Leo Leon Lucas Marco Martin Max Nico Noah Oliver Oscar Oswald Pablo Paul Philip Rafael Ralph Robert Samuel Simon Stefan Theo Thomas Tobias Victor Vincent Walter William Xavier".split()
_FEMALE = "Ada Adele Agnes Alice Alma Amelia Anita Anna Aurora Beatrice Berta Bianca Carla Cecilia Clara Daria Diana Dora Edith Elena Elsa Emma Erika Eva Fiona Flora Frieda Gloria Greta Hanna Helen Ida Ines Irene Iris Jana Johanna Julia Karin Klara Laura Lea Linda Lucia Lydia Maria Marta Mila Nadia Nora Olga Paula Petra Regina Rita Rosa Sara Silvia Sophia Teresa Tina Ursula Vera Wanda".split()
_MALE_RU = "Александр Алексей Андрей Антон Борис Вадим Виктор Глеб Денис Дмитрий Егор Иван Игорь Кирилл Константин Лев Максим Михаил Никита Николай Олег Павел Пётр Роман Семён Сергей Степан Тимур Фёдор Юрий".split()
_FEMALE_RU = "Алина Алла Анастасия Анна Берта Валентина Вера Галина Дарья Ева Елена Жанна Зоя Инна Ирина Кира Клара Ксения Лариса Лидия Людмила Марина Мария Нина Оксана Ольга Полина Раиса Светлана Тамара".split()
_SYLLABLES = "ba be bo da de do fa fe ka ke ko la le lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te".split()
_SYLLABLES_RU = "ба бе бо ва ве да де до за ка ке ко ла ле ло ма ме ми мо на не но па пе ра ре ро са се со та те".split()

_TITLE = f"(?:{_MALE_TITLES}|{_FEMALE_TITLES}|{_OTHER_TITLES})"
_NAME = r"\p{Lu}[\p{L}'’]{1,29}" + r"(?:[-‐]\p{L}[\p{L}'’]{0,29})?" * 2  # groups that repeat can't be looked for backwards
_BETWEEN = r"(?:\p{Lu}\. ?|(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|zu|ter|bin|al|el) )"  # initials and particles, which stay
_EARLIER = f"(?:{_NAME} |{_BETWEEN})?" * 4
PATTERNS = {
    "email": r"(?<![\w.%+\-])[\w.%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w\-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,5}\)[ .\-]?|\d{2,5}[ .\-])\d{3,4}(?:[ .\-]\d{3,4}){1,2}(?![\w\-])|(?<![\w.])(?:\+\d{1,3}[ .\-]?)?\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?![\w\-])",
    "given": rf"(?<=(?<!\w){_TITLE}\.? ){_NAME}(?= {_BETWEEN}{{0,3}}{_NAME})",
    "family": rf"(?<=(?<!\w){_TITLE}\.? {_EARLIER}){_NAME}",
}
_NUMBERS = "(?=[+(0-9])"  # checked first, as most places fail it
PLAIN = f"(?:{PATTERNS['email']})|(?:{PATTERNS['iban']})|{_NUMBERS}(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "card", "ssn", "phone")) + ")"
NAMED = rf"{PLAIN}|(?=\p{{Lu}})(?:(?:{PATTERNS['given']})|(?:{PATTERNS['family']}))"
_TITLED = rf"(?<!\w){_TITLE}\.? \p{{Lu}}"
_SHORT = 3  # attempts after the first before a format counts as too short
_DIGITS = ("iban", "card", "ssn", "phone")


def _kind(hit: Column, before: Column, behind: Column) -> Column:
    """The entity's type: by its whole form, and for names by the title before it."""
    found = F.coalesce(*(F.when(hit.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)) for k in ("email", "iban", "ip", "card", "ssn", "phone")))
    title = F.regexp_extract(before, rf"({_TITLE})\.? $", 1)
    gender = F.when(title.rlike(f"^(?:{_MALE_TITLES})$"), F.lit("_m")).when(title.rlike(f"^(?:{_FEMALE_TITLES})$"), F.lit("_f")).otherwise(F.lit("_u"))
    given = before.rlike(rf"{_TITLE}\.? $") & behind.rlike(f"^ {_BETWEEN}{{0,3}}{_NAME}")
    return F.coalesce(found, F.when(given, F.concat(F.lit("given"), gender)).otherwise(F.lit("family")))


def _normal(kind: Column, hit: Column) -> Column:
    return F.when(kind == "iban", F.upper(F.regexp_replace(hit, " ", ""))).when(kind.isin(*_DIGITS), F.regexp_replace(hit, "[^0-9]", "")).otherwise(F.lower(hit))


def _by(named: Column, f) -> Column:
    """f with the pattern for texts with a title before a name, or with the plain one, which is much faster."""
    return F.when(named, f(NAMED)).otherwise(f(PLAIN))


def has_entity(text: Column) -> Column:
    named, plain = text.rlike(_TITLED), text.rlike("[@0-9]")
    return F.coalesce((named | plain) & _by(named, text.rlike), F.lit(False))


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' rows with an entity, and `hits`: an array of (kind, entity, mention) in the order of the text."""
    named = F.col(text_col).rlike(_TITLED)
    t = docs.withColumn("hits", _by(named, lambda p: F.regexp_extract_all(text_col, F.lit(p), F.lit(0)))).where(F.size("hits") > 0)
    t = t.withColumn("_parts", _by(named, lambda p: F.split(text_col, p, -1)))
    # what stands right before and behind a hit; a given name may itself be the hit before a family name
    beside = F.transform("hits", lambda h, i: F.struct(h.alias("h"), F.concat(F.when((F.length(F.element_at("_parts", i + 1)) <= 1) & (i > 0), F.concat(F.right(F.element_at("_parts", F.greatest(i, F.lit(1))), F.lit(24)), F.element_at("hits", F.greatest(i, F.lit(1))))).otherwise(F.lit("")), F.right(F.element_at("_parts", i + 1), F.lit(64))).alias("b"), F.concat(F.left(F.element_at("_parts", i + 2), F.lit(40)), F.when((F.length(F.element_at("_parts", i + 2)) <= 24) & (i + 2 <= F.size("hits")), F.element_at("hits", F.least(i + 2, F.size("hits")))).otherwise(F.lit(""))).alias("a")))
    t = t.withColumn("_beside", beside)
    kinds = F.transform("_beside", lambda x: F.struct(_kind(x["h"], x["b"], x["a"]).alias("kind"), x["h"].alias("mention")))
    return t.withColumn("hits", F.transform(kinds, lambda x: F.struct(x["kind"].alias("kind"), _normal(x["kind"], x["mention"]).alias("entity"), x["mention"].alias("mention")))).drop("_parts", "_beside")


def _byte(seed: Column, i: Column) -> Column:
    """A number from 0 to 4294967295 for place i, keyed."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 8), 16, 10).cast("long")


def _pick(items: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (n % len(items) + 1).cast("int"))


def _redrawn(text: Column, seed: Column) -> Column:
    """Each digit and letter replaced by a keyed one of its own kind; other characters stay."""
    # The alphabets that letters are drawn from
    latin, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
    letter = lambda c, n, letters: (lambda x: F.when(F.upper(c) == c, F.upper(x)).otherwise(x))(F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1)))
    one = lambda c, i: (lambda n: F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike(r"\p{IsCyrillic}"), letter(c, n, cyrillic)).when(c.rlike(r"\p{IsGreek}"), letter(c, n, greek)).when(c.rlike(r"\p{L}"), letter(c, n, latin)).otherwise(c))(_byte(seed, i))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn checksum, the last digit included."""
    at = F.transform(F.reverse(F.split(digits, "")), lambda c, i: (lambda d: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))(c.cast("int")))
    return F.aggregate(at, F.lit(0), lambda s, d: s + d)


def _mod97(text: Column) -> Column:
    """An account number's digits and letters (10 to 35) as one number, modulo 97."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """What replaces the entity (in its reduced form) at the given attempt."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 256)
    digits = F.concat(F.left(entity, F.lit(1)), _redrawn(F.substring(entity, F.lit(2), F.length(entity)), seed))
    fixed = F.concat(F.left(digits, F.length(digits) - 1), F.lit("0"))
    card = F.when(_luhn(entity) % 10 == 0, F.concat(F.left(digits, F.length(digits) - 1), F.pmod(-_luhn(fixed), F.lit(10)).cast("string"))).otherwise(digits)
    country, account = F.left(entity, F.lit(2)), _redrawn(F.substring(entity, F.lit(5), F.length(entity)), seed)
    holds = _mod97(F.concat(F.substring(entity, F.lit(5), F.length(entity)), F.left(entity, F.lit(4)))) == 1
    sum_ = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(holds, sum_).otherwise(_redrawn(F.substring(entity, F.lit(3), F.lit(2)), seed)), account)
    russian = entity.rlike(r"\p{IsCyrillic}")
    n = _byte(seed, F.lit(0))
    named = lambda a, b: F.when(russian, _pick(b, n)).otherwise(_pick(a, n))
    made = lambda i: F.when(russian, _pick(_SYLLABLES_RU, _byte(seed, i))).otherwise(_pick(_SYLLABLES, _byte(seed, i)))
    # a format whose values run short gets one more place with every further attempt
    longer = F.greatest(attempt - _SHORT, F.lit(0))
    places = F.when(longer > 0, F.sequence(F.lit(100), longer + 99)).otherwise(F.array().cast("array<int>"))
    grown = lambda each: F.array_join(F.transform(places, each), "")
    digit = grown(lambda i: (_byte(seed, i) % 10).cast("string"))
    email = _redrawn(F.regexp_extract(entity, r"^(.*)\.[a-z]+$", 1), seed)
    email = F.concat(F.substring_index(email, "@", 1), grown(lambda i: _pick(list("abcdefghijklmnopqrstuvwxyz"), _byte(seed, i))), F.lit("@"), F.substring_index(email, "@", -1), F.lit("."), F.regexp_extract(entity, r"\.([a-z]+)$", 1))
    ip = F.concat_ws(".", *((_byte(seed, F.lit(i)) % 254 + 1).cast("string") for i in range(4)))
    ip = F.when(longer == 0, ip).otherwise(F.concat(F.lit("2001:db8"), *(x for i in range(4, 10) for x in (F.lit(":"), F.lower(F.hex(_byte(seed, F.lit(i)) % 65536))))))  # the documentation range, where IPv4 runs short
    more = F.when(attempt == 0, F.lit("")).otherwise(F.concat(F.lit("-"), F.initcap(F.concat(*(made(F.lit(i)) for i in range(9, 13)), grown(made)))))
    is_one = lambda *names: (kind == "given_u") & entity.isin(*(n.lower() for x in names for n in x))  # noqa: E731  a neutral title, but a name of one gender
    given = F.when((kind == "given_m") | is_one(_MALE, _MALE_RU), named(_MALE, _MALE_RU)).when((kind == "given_f") | is_one(_FEMALE, _FEMALE_RU), named(_FEMALE, _FEMALE_RU)).otherwise(named(_MALE + _FEMALE, _MALE_RU + _FEMALE_RU))
    family = F.initcap(F.concat(*(made(F.lit(i)) for i in range(1, 6)), grown(made)))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind.isin("ssn", "phone"), F.concat(_redrawn(entity, seed), digit)).when(kind == "family", family).otherwise(F.concat(given, more))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): one to one, and apart from all entities; names of all kinds count as one.

    Only those that collide draw again. From the fifth attempt on a surrogate is longer by a place with
    each attempt, so that a format with fewer values than entities has enough: an address in its local
    part, a number by further digits, a name by syllables; an IPv4 address becomes one of IPv6.
    """
    group = F.when(F.col("kind").startswith("given") | (F.col("kind") == "family"), F.lit("name")).otherwise(F.col("kind"))
    entities = written(entities.withColumn("of", group))
    drawn = entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.lit(0), key))
    real = entities.select("of", F.col("entity").alias("_s")).distinct()
    while True:
        drawn = drawn.withColumn("_s", F.lower("surrogate"))
        first = Window.partitionBy("of", "_s").orderBy("entity", "kind")
        drawn = written(drawn.withColumn("again", F.row_number().over(first) > 1).join(real.withColumn("taken", F.lit(True)), ["of", "_s"], "left").withColumn("again", F.col("again") | F.coalesce("taken", F.lit(False))).drop("_s", "taken"))
        if drawn.where("again").isEmpty():
            return drawn.select("kind", "entity", "surrogate")
        drawn = drawn.withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))
        drawn = drawn.withColumn("surrogate", F.when(F.col("again"), surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)).otherwise(F.col("surrogate"))).drop("again")


def _in_format(kind: Column, mention: Column, new: Column) -> Column:
    """The surrogate written as the mention is."""
    place = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9]", ""))
    digits = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")
    further = F.substring(new, F.length(F.regexp_replace(mention, "[^0-9]", "")) + 1, F.length(new))
    digits = F.concat(digits, F.coalesce(further, F.lit("")))
    spaced = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    shouted = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    return F.when(kind == "iban", spaced).when(kind.isin(*_DIGITS), digits).when(shouted, F.upper(new)).otherwise(new)


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, n_replaced): every row's whole text with surrogates for its entities.

    Null text stays null; rows without entities pass unchanged (0 replaced); null ids are kept,
    repeated rows give equal results; other columns are ignored. The same key gives the same
    surrogates for the same set of entities. An empty table gives none.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    hit = has_entity(F.col("t"))
    rows = written(mentions(docs.where(hit), "t").withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.posexplode("hits").alias("nth", "x")).select("row", "nth", "x.*")
    given = F.col("kind").startswith("given")
    each = each.select("row", "nth", F.when(given, "given").otherwise(F.col("kind")).alias("kind"), "entity", "mention", F.col("kind").alias("as"))
    titles = each.groupBy("kind", "entity").agg(F.max(F.col("as") == "given_m").alias("m"), F.max(F.col("as") == "given_f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "_m").when(F.col("f") & ~F.col("m"), "_f").otherwise("_u")
    names = surrogates(titles.select(F.when(F.col("kind") == "given", F.concat("kind", gender)).otherwise(F.col("kind")).alias("kind"), "entity"), key)
    names = names.withColumn("kind", F.when(given, "given").otherwise(F.col("kind")))
    # an entity of very many mentions is split by the salt
    salts = 8
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    put = each.withColumn("salt", F.pmod(F.xxhash64("row", "nth"), F.lit(salts)).cast("int")).join(names, ["kind", "entity", "salt"])
    put = put.select("row", F.struct("nth", _in_format(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("s")).alias("x"))
    put = put.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("put"))  # as many as the text has
    text = F.array_join(F.transform(_by(F.col("t").rlike(_TITLED), lambda x: F.split("t", x, -1)), lambda p, i: F.concat(p, F.coalesce(F.try_element_at("put", i + 1)["s"], F.lit("")))), "")
    changed = rows.select("row", "id", "t").join(put, "row").select("id", text.alias("t"), F.size("put").cast("long").alias("n_replaced"))
    out = docs.where(~hit).withColumn("n_replaced", F.lit(0).cast("long")).unionByName(changed)
    return out.select(F.col("id").alias(id_col), F.col("t").alias(text_col), "n_replaced")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), key="readmill")
