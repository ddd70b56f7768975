"""Personal data: keyed surrogates of the same type and form, in DataFrame and SQL functions only.

What is found (e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card numbers with a right check digit, IBANs with
right check digits, social security numbers, secrets after their keyword, persons after a form of address) is replaced by
a surrogate that depends on a key, the type and the entity alone: the same entity gets the same surrogate in every
document, whatever its case or separators. Digits stand for digits and letters for letters, separators and case stay,
check digits are right again.

A person who is named with a form of address is found in the rest of that document without it, too, by full name or
family name. A family name has one surrogate; so 'Dr. Anna Schmidt', 'Frau Schmidt' and 'Anna Schmidt' stay one person. A
given name is drawn for the full name, in its script, and in the gender that the forms of address tell, those of the
family name alone included if the document has one full name with it.

Surrogates are checked: two entities of one type that would share a surrogate, or a surrogate that is itself an entity of
the corpus, are drawn again. Texts are searched once; only those with mentions go through shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm._shared import LOWER, UPPER, staged, unused

KEY = "thicket"

# Forms of address by gender; given names by gender and script; syllables of family names by script.
MALE = ["Mr", "Herr", "Herrn", "Señor", "Monsieur", "Don", "господин", "Господин", "κύριος", "Κύριος", "պարոն", "Պարոն"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Doña", "госпожа", "Госпожа", "κυρία", "Κυρία", "տիկին", "Տիկին"]
EITHER = ["Dr", "Prof", "Professor", "Doctor", "Doktor", "доктор", "Доктор"]
GIVEN = {
    "mL": ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Martin", "Noel", "Oscar", "Peter", "Simon"],
    "fL": ["Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Sara"],
    "eL": ["Alex", "Robin", "Kim", "Sascha", "Andrea", "Charlie", "Dominique", "Camille"],
    "mC": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Илья", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Сергей", "Тимур", "Фёдор"],
    "fC": ["Алла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Софья", "Юлия"],
    "eC": ["Саша", "Женя", "Валя", "Слава"],
    "mG": ["Ανδρέας", "Γιάννης", "Δημήτρης", "Ηλίας", "Κώστας", "Λευτέρης", "Μάρκος", "Νίκος"],
    "fG": ["Άννα", "Βασιλική", "Δέσποινα", "Ελένη", "Ζωή", "Θάλεια", "Κατερίνα", "Μαρία"],
    "eG": ["Χάρις", "Φώτη"],
    "mA": ["Արամ", "Գագիկ", "Դավիթ", "Հակոբ", "Կարեն", "Նարեկ", "Սամվել", "Տիգրան"],
    "fA": ["Անի", "Գայանե", "Եվա", "Լիլիթ", "Մարիամ", "Նարե", "Սոնա", "Տաթև"],
    "eA": ["Արև", "Հայկազ"],
}
SYLLABLES = {
    "L": ["ba", "den", "fel", "gor", "hal", "kin", "lo", "mar", "nes", "pol", "rin", "sol", "ta", "ver", "win", "zan"],
    "C": ["ба", "вен", "гор", "дал", "зин", "кар", "ло", "мир", "нес", "пол", "рин", "сол", "та", "фед", "хан", "чер"],
    "G": ["βα", "γορ", "δα", "ζαν", "θεο", "κα", "λο", "μαρ", "νι", "πα", "ρο", "σολ", "τα", "φι", "χα", "ψα"],
    "A": ["բա", "գոր", "դա", "զան", "թե", "կա", "լո", "մար", "նի", "պա", "րո", "սոլ", "տա", "ֆի", "խա", "չա"],
}
SCRIPTS = {"C": r"\p{IsCyrillic}", "G": r"\p{IsGreek}", "A": r"\p{IsArmenian}"}
#: Capital words that stand after a name, and small ones that stand inside one.
NOT_NAMES = "Yesterday Today Tomorrow Now Then Later Meanwhile Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December The This That These Those He She It They We You I And But Or If When While After Before Who What Gestern Heute Morgen Dann Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Der Die Das Er Sie Es Und Aber".split()
PARTICLES = "van von de der den del della di da la le ter zu".split()

_TITLES = "|".join([*MALE, *FEMALE, *EITHER])
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
# Groups repeat a bounded number of times everywhere: the matcher takes stack for each turn of an unbounded one.
_FORM = rf"(?:(?:{_TITLES})\.? {{1,2}}){{1,4}}"
_TOKEN = rf"(?!(?:{'|'.join(NOT_NAMES)}|{_TITLES})(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}+|\.|(?=['’]))(?:['’\-]\p{{L}}{{2,}}){{0,3}}"
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}"
#: What is found, in the order in which it is tried at each place. Cards and IBANs count if their check digits are right.
PATTERNS = {
    "secret": r"(?<=(?i:token|secret|api_key|api-key|apikey|access_key)[ ]{0,3}[=:][ ]{0,3}[\"']?)(?=[A-Za-z_\-+/.]*+[0-9])[A-Za-z0-9_\-+/.]{8,}"
    r"|(?<=(?i:password|passwd|passphrase|(?<![a-z])pwd?)[ ]{0,3}[=:][ ]{0,3}[\"']?)(?=[A-Za-z_\-+/.]*+[0-9])[A-Za-z0-9_\-+/.]{6,}",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+){0,126}\.[A-Za-z]{2,}",
    "ipv6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|[23fF][0-9A-Fa-f]{{3}}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])",
    "ip": rf"(?<![\w.])(?<!(?i:version|release|build|section|ver\.?) ?){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|(?<![.\-/])0\d{2,4}[ /\-](?:\d{5,8}|\d{3,4}[ \-]\d{3,5})(?![\w\-]))(?!\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5})(?!\w)",
    "person": rf"(?<![\p{{L}}]){_FORM}{_SMALL}{_TOKEN}(?: {_SMALL}{_TOKEN}){{0,2}}",
}
ANY = "|".join(PATTERNS.values())
#: Every pattern needs a digit, an at sign or a form of address: texts without them aren't searched further.
HINT = rf"[0-9@]|(?<![\p{{L}}])(?:{_TITLES})(?![\p{{L}}])"


# --- forms ----------------------------------------------------------------------------------------------------------


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column, doubled: int = 0) -> Column:
    """The Luhn sum of a string of digits; doubled: the remainder, by 2, of the places from the right that count twice."""

    def add(total, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 != doubled, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters, A being 10."""

    def add(rest, i):
        c = F.ascii(F.substr(text, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def kind_of(m: Column, titled: Column) -> Column:
    """The type of a mention, by its form; 'none' for what only looks like one. titled: the forms of address before it."""
    full = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    card = (F.pmod(luhn(_digits(m)), F.lit(10)) == 0) & ~((F.length(_digits(m)) == 13) & _digits(m).rlike("^97[89]"))
    iban = F.replace(m, F.lit(" "), F.lit(""))
    iban = mod97(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))) == 1
    kind = F.when(titled != "", "person").when(full["email"], "email").when(full["ipv6"], "ipv6")
    kind = kind.when(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip").when(full["phone"], "phone").when(full["ssn"], "ssn")
    kind = kind.when(full["card"], F.when(card, "card").otherwise("none")).when(full["iban"], F.when(iban, "iban").otherwise("none"))
    return kind.when(~m.rlike("[0-9]"), "name").otherwise("secret")  # a secret holds a digit


def norm_of(kind: Column, m: Column) -> Column:
    """What the mentions of one entity have in common."""
    norm = F.when(kind.isin("phone", "ssn", "card"), _digits(m)).when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
    return norm.when(kind.isin("email", "ipv6", "family", "given"), F.lower(m)).otherwise(m)


# --- surrogates -----------------------------------------------------------------------------------------------------


def _byte(seed: Column, i: Column | int) -> Column:
    """Byte i of an endless digest of seed."""
    i = i if isinstance(i, Column) else F.lit(i)
    block = F.sha2(F.concat(seed, F.lit("#"), F.floor(i / 32).cast("string")), 256)
    return F.conv(F.substr(block, 1 + 2 * (i % 32), F.lit(2)), 16, 10).cast("int")


def _each(v: Column, change) -> Column:
    """v with change(character, its place) for each character."""
    return F.array_join(F.transform(F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)), change), "")


def _spell(v: Column, seed: Column) -> Column:
    """Digits for digits, small and capital letters for such; the rest stays."""

    def change(c, i):
        b = _byte(seed, i)
        other = F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
        for some, letters in (("[a-z]", LOWER), ("[A-Z]", UPPER)):
            other = other.when(c.rlike(some), F.substr(F.lit(letters), b % 26 + 1, F.lit(1)))
        return other.otherwise(c)

    return _each(v, change)


def _hexed(v: Column, seed: Column) -> Column:
    return _each(v, lambda c, i: F.when(c.rlike("[0-9a-fA-F]"), F.substr(F.lit("0123456789abcdef"), _byte(seed, i) % 16 + 1, F.lit(1))).otherwise(c))


def _lists(of: dict[str, list[str]]) -> Column:
    return F.create_map(*(x for k, v in of.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, norm, gender, tries) with sur, the surrogate in the form of norm. Names are drawn from lists of the
    script of norm (Latin for scripts without lists); each further try makes them longer, so their supply has no end."""
    kind, norm, seed, tries = F.col("kind"), F.col("norm"), F.col("seed"), F.col("tries")
    script = F.lit("L")
    for name, pattern in SCRIPTS.items():
        script = F.when(norm.rlike(pattern), name).otherwise(script)
    values = F.when(kind == "family", F.element_at(_lists(SYLLABLES), script)).when(kind == "given", F.element_at(_lists(GIVEN), F.concat("gender", script)))
    rows = entities.withColumn("seed", F.sha2(F.concat_ws("|", F.lit(key), kind, norm, tries.cast("string")), 256)).withColumn("values", values)
    # The country code of a phone number, the issuer of a card, the country of an IBAN, the beginning of an IPv6 address stay.
    spelt = _spell(F.when(kind == "email", F.substring_index(norm, "@", 1)).when(kind == "iban", F.substr(norm, F.lit(5))).when(kind.isin("phone", "card"), F.substr(norm, F.lit(2))).otherwise(norm), seed)
    # Private addresses stay private, as long as their range has enough of them; link-local ones stay link-local.
    head = F.when(kind == "ipv6", F.when(norm.rlike("^fe[89ab]"), 4).when(norm.rlike("^f[cd]"), 2).otherwise(1)).otherwise(0)
    hexed = _hexed(F.substr(norm, head + 1), seed)
    wide = F.regexp_extract(norm, r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", 0)
    octets = lambda n: F.concat_ws(".", *((1 + _byte(seed, i) % 254).cast("string") for i in range(n)))
    two = F.length(F.regexp_replace(wide, "[^.]", "")) == 2
    ip = F.when((wide == "") | (tries >= 9), octets(4)).when(two & (tries < 4), F.concat(wide, octets(2))).when(two, F.concat(F.lit("10."), octets(3))).otherwise(F.concat(wide, octets(3)))
    double = (kind == "family") & F.contains(norm, F.lit("-"))
    names = F.transform(F.sequence(F.lit(0), tries + F.when(double, 3).when(kind == "family", 2).otherwise(0)), lambda j: F.col("values")[_byte(seed, j) % F.size("values")])
    by_hex = (kind == "ipv6") | (kind == "secret") & norm.rlike("^[0-9a-f]+$")
    made = F.when(kind == "ip", ip).when(by_hex, hexed)
    halves = (F.initcap(F.array_join(x, "")) for x in (F.slice(names, 1, 2), F.slice(names, F.lit(3), F.greatest(F.size(names) - 2, F.lit(0)))))
    made = made.when(double, F.concat_ws("-", *halves)).when(kind == "family", F.initcap(F.array_join(names, ""))).when(kind == "given", F.array_join(names, "-")).otherwise(spelt)
    rows = rows.withColumn("made", made)
    made, first = F.col("made"), F.substr(norm, F.lit(1), F.lit(1))
    mail = F.concat(made, F.lit("@m"), F.substr(F.sha2(seed, 256), F.lit(1), F.lit(6)), F.lit(".example.net"))
    body = F.concat(first, F.substr(made, F.lit(1), F.length(made) - 1))
    country = F.substr(norm, F.lit(1), F.lit(2))
    check = (98 - mod97(F.concat(made, country, F.lit("00")))).cast("string")
    sur = F.when(kind == "email", mail).when(kind == "ipv6", F.concat(F.substr(norm, F.lit(1), head), made)).when(kind == "phone", F.concat(first, made)).when(kind == "iban", F.concat(country, F.lpad(check, 2, "0"), made))
    sur = sur.when(kind == "card", F.concat(body, ((10 - luhn(body, 1) % 10) % 10).cast("string"))).otherwise(made)
    return rows.withColumn("sur", sur).drop("seed", "values", "made")


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, sur) for distinct entities (kind, norm, gender). Given names are distinct within a family name.

    Of entities that share a surrogate, the one that sorts first keeps it; a surrogate that is an entity itself is never
    kept. Each round draws only for those that still clash, until none does.
    """
    whole = F.lower(F.when(F.col("kind") == "given", F.concat("sur", F.lit(" "), F.substring_index("norm", " ", -1))).otherwise(F.col("sur")))
    tasks = 2 * entities.sparkSession.sparkContext.defaultParallelism  # drawing is work: it is dealt out however few bytes there are
    drawn = staged(_drawn(entities.select("kind", "norm", "gender", F.lit(0).alias("tries")).repartition(tasks, "kind", "norm"), key), "drawn")
    taken = entities.select("kind", F.lower("norm").alias("s")).distinct().withColumn("taken", F.lit(True))
    while True:
        named = drawn.withColumn("s", whole)
        same = named.groupBy("kind", "s").agg(F.min("norm").alias("keeps"))
        again = (F.col("norm") != F.col("keeps")) | F.col("taken").isNotNull()
        marked = named.join(same, ["kind", "s"]).join(taken, ["kind", "s"], "left")
        marked = staged(marked.select("kind", "norm", "gender", (F.col("tries") + again.cast("int")).alias("tries"), "sur", again.alias("again")), "drawn")
        kept = marked.where(~F.col("again")).drop("again")
        clash = marked.where("again")
        if not clash.limit(1).count():
            return kept.select("kind", "norm", "sur")
        drawn = kept.unionByName(staged(_drawn(clash.drop("again", "sur"), key).select(*kept.columns), "drawn"))


# --- texts ----------------------------------------------------------------------------------------------------------


def _bare(names: Column) -> Column:
    """A pattern for the names of a document where they stand without a form of address; full names come first."""
    family = F.transform(names, lambda n: F.substring_index(n, " ", -1))
    all_ = F.filter(F.array_distinct(F.concat(names, family)), lambda n: n.rlike(r"\p{L}\p{L}$"))
    # In groups by their first two letters, so that a word is held against the names that begin like it, however many
    # there are; in a group the longest comes first.
    keyed = F.array_sort(F.transform(all_, lambda n: F.struct(F.substr(n, F.lit(1), F.lit(2)).alias("begin"), (-F.length(n)).alias("size"), n.alias("n"))))
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    group = lambda k: F.concat(F.lit("(?="), quoted(k["begin"]), F.lit(")(?:"), quoted(k["n"]))
    before = F.concat(F.array(F.lit("")), F.transform(keyed, lambda k: k["begin"]))  # one longer: its last pair gives null
    piece = lambda k, b: F.when(k["begin"] == b, F.concat(F.lit("|"), quoted(k["n"]))).otherwise(F.concat(F.when(b == "", "").otherwise(")|"), group(k)))
    rule = F.array_join(F.zip_with(keyed, before, piece), "")
    return F.when(F.size(keyed) == 0, ANY).otherwise(F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), rule, F.lit(r"))(?![\p{L}\p{N}])")))


def _mentions(texts: DataFrame) -> DataFrame:
    """(key, pos, m, kind, norm, title, pre, gender): the mentions of texts (key, pattern, text). For persons norm is the
    family name, pre what stands before it, and full says that this holds a given name."""
    found = texts.select("key", F.posexplode(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).alias("pos", "m"))
    title = F.regexp_extract("m", f"^{_FORM}", 0)
    named = found.withColumn("title", title).withColumn("kind", kind_of(F.col("m"), F.col("title")))
    name = F.substr(F.col("m"), F.length("title") + 1)
    family = F.substring_index(name, " ", -1)
    person = F.col("kind").isin("person", "name")
    gender = F.when(F.col("title").rlike(rf"(?:^|[ .])(?:{'|'.join(MALE)})[ .]"), "m").when(F.col("title").rlike(rf"(?:^|[ .])(?:{'|'.join(FEMALE)})[ .]"), "f")
    return named.select(
        "key", "pos", "m", F.when(person, "family").otherwise(F.col("kind")).alias("kind"), F.when(person, F.lower(family)).otherwise(norm_of(F.col("kind"), F.col("m"))).alias("norm"),
        F.when(person, F.col("title")).alias("title"), F.when(person, F.trim(F.substr(name, F.lit(1), F.length(name) - F.length(family)))).alias("pre"), gender.alias("gender"),
    ).withColumn("full", F.when(F.col("pre").rlike(r"\p{Lu}"), F.concat(F.lower("pre"), F.lit(" "), F.col("norm"))))


def _entities(found: DataFrame) -> DataFrame:
    """Distinct (kind, norm, gender) of the mentions; gender is that of all forms of address, 'e' where they tell none or both."""
    persons = found.where("kind = 'family'")
    one = persons.groupBy("key", "norm").agg(F.min("full").alias("x"), F.max("full").alias("y")).where("x = y").select("key", "norm", F.col("x").alias("only"))
    told = persons.join(one, ["key", "norm"], "left").select(F.coalesce("full", "only").alias("norm"), "gender").where("norm is not null")
    told = told.groupBy("norm").agg(F.min("gender").alias("x"), F.max("gender").alias("y"))
    given = told.select(F.lit("given").alias("kind"), "norm", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.lit("e")).alias("gender"))
    return found.where("kind <> 'none'").select("kind", "norm").distinct().select("kind", "norm", F.lit("e").alias("gender")).unionByName(given)


def _rendered() -> Column:
    """The surrogate in the form of the mention: its separators, its case, its form of address."""
    m, sur = F.col("m"), F.col("sur")
    kept = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^0-9A-Z]", ""))
    spaced = _each(m, lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substr(sur, kept(i), F.lit(1))).otherwise(c))
    name = F.concat_ws(" ", F.coalesce("given", F.when(F.col("pre") != "", F.col("pre"))), sur)
    loud = F.substr(m, F.length("title") + 1)
    person = F.concat("title", F.when(loud == F.upper(loud), F.upper(name)).otherwise(name))
    upper = F.col("kind").isin("email", "ipv6") & (m == F.upper(m)) & m.rlike("[A-Z]")
    return (
        F.when(F.col("kind") == "none", m).when(F.col("kind").isin("phone", "ssn", "card", "iban"), spaced)
        .when(F.col("kind") == "family", person).when(upper, F.upper(sur)).otherwise(sur)
    )


def rewritten(texts: DataFrame, key: str = KEY) -> DataFrame:
    """(key, new, n, kinds) of distinct texts (key, text)."""
    titled = F.filter(F.regexp_extract_all("text", F.lit(PATTERNS["person"]), F.lit(0)), lambda m: m != "")
    names = F.transform(titled, lambda m: F.regexp_replace(F.regexp_replace(m, f"^{_FORM}", ""), f"^{_SMALL}(?=\\p{{Lu}})", ""))
    texts = staged(texts.withColumn("pattern", F.when(F.size(titled) > 0, _bare(names)).otherwise(F.lit(ANY))), "texts")
    found = staged(_mentions(texts), "mentions")
    sur = surrogates(staged(_entities(found), "entities"), key)
    given = sur.where("kind = 'given'").select(F.col("norm").alias("full"), F.col("sur").alias("given"))
    made = found.join(sur, ["kind", "norm"], "left")
    # Most mentions are of no person: they don't take part in the second join.
    made = made.where("full is null").withColumn("given", F.lit(None).cast("string")).unionByName(made.where("full is not null").join(given, "full", "left"))
    made = made.select("key", "pos", _rendered().alias("to"), F.when(F.col("kind") == "family", F.lit("person")).when(F.col("kind") != "none", F.col("kind")).alias("kind"))
    made = made.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "to", "kind"))).alias("done"))
    gaps = texts.select("key", F.split("text", F.col("pattern"), -1).alias("gaps")).join(made, "key")
    new = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.when(i < F.size("done"), F.col("done")[i]["to"]).otherwise(F.lit("")))), "")
    kinds = F.filter(F.transform("done", lambda d: d["kind"]), lambda k: k.isNotNull())
    return gaps.select("key", new.alias("new"), F.size(kinds).cast("long").alias("n"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))


def replace_pii(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with text_col's personal data replaced, and with columns pii_count (mentions replaced, long) and pii_kinds
    (their distinct types, sorted). Null stays null, with count 0. Everything between mentions stays as it is. Rows are
    neither added nor dropped, repeated rows get the same text; columns of docs with those two names are replaced.

    Not found: persons that no form of address names, given names alone, names in scripts without capital letters.
    """
    base = docs.select(*[c for c in docs.columns if c.lower() not in ("pii_count", "pii_kinds")])
    hit, own = (unused(n, base.columns) for n in ("hit", "key"))
    text = F.col(text_col).cast("string")
    marked = staged(base.withColumn(hit, F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))), "searched")
    some = marked.where(hit).drop(hit).withColumn(own, F.md5(text))
    texts = some.groupBy(F.col(own).alias("key")).agg(F.first(text).alias("text"))
    new = staged(rewritten(texts, key), "rewritten").select(F.col("key").alias(own), F.struct("new", "n", "kinds").alias(hit))
    # A text that very many rows have is split by Spark: it has one row on the other side.
    done = some.join(new, own)
    cols = [F.col(f"{hit}.new").alias(c) if c == text_col else F.col(c) for c in base.columns]
    done = done.select(*cols, F.col(f"{hit}.n").alias("pii_count"), F.col(f"{hit}.kinds").alias("pii_kinds"))
    rest = marked.where(~F.col(hit)).select(*[text.alias(c) if c == text_col else F.col(c) for c in base.columns], F.lit(0).cast("long").alias("pii_count"), F.array().cast("array<string>").alias("pii_kinds"))
    return rest.unionByName(done)
