"""PII surrogates: detected entities get keyed replacements of their own type and format.

Detection is one pattern of alternatives (emails, phones, IPv4 addresses, card and national numbers, IBANs, secrets
after a key word, names after a title or a label). In a text with such a name its words count again wherever they stand
bare and begin with a capital. Each distinct entity is split into parts (a name into given and family names), each part
into its normal form (digits of a phone, lower case of an email or name), so that spellings of one thing are one part.
Each distinct part gets one surrogate for the whole corpus, made from SHA-256 of a key of its type and the part: digits
stay digits, letters stay letters, cards and IBANs that pass their check still do, names follow the title's gender and
the script. Surrogates of a type that meet, or that equal a part that really occurs, are drawn anew with a counter until
none do, so distinct parts stay distinct; after LENGTHEN draws a format counts as used up and the surrogate gets longer. A
mention takes its part's surrogate in its own spelling: the same signs between the digits, the same case.

DataFrame functions only. Texts are rewritten by position: the pieces between the matches and the surrogates, in turn.
Only texts with an entity are moved. The key is in no plan: it reaches the executors as the rows of a small table.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, own_prefix, text_key

# Titles and the names that stand in at the first draw.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"]
OTHER_TITLES = ["Dr", "Prof", "Mx"]
NAME_LABELS = ["name", "contact", "author", "nom", "nombre", "autor", "имя"]
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Karel", "Leo", "Martin", "Noel", "Oscar", "Paul", "Simon", "Tomas"],
    ("f", "latin"): ["Alma", "Clara", "Diana", "Edith", "Flora", "Greta", "Helena", "Ida", "Julia", "Lena", "Maria", "Nora", "Olga", "Paula", "Rosa", "Vera"],
    ("n", "latin"): ["Alex", "Andrea", "Chris", "Dana", "Jules", "Kim", "Robin", "Sascha"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"],
    ("f", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ольга"],
    ("n", "cyrillic"): ["Валя", "Женя", "Саша", "Слава"],
}
FAMILY = {
    "latin": ["Albrecht", "Bergman", "Castell", "Delaney", "Ekholm", "Ferrand", "Garnier", "Holloway", "Ivarsen", "Jansen", "Keller", "Lindqvist", "Moreau", "Navarro", "Ortega", "Pascal"],
    "cyrillic": ["Белов", "Волков", "Громов", "Ершов", "Зайцев", "Лосев", "Орлов", "Чернов"],
}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "we", "xi", "zo"], "cyrillic": ["ба", "ве", "ги", "до", "жа", "зе", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "фи", "хо"]}

#: Country codes of the international numbering plan: of one, two or three digits.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

_FEMALE, _MALE = ("(?:" + "|".join(t) + r")\.? " for t in (FEMALE_TITLES, MALE_TITLES))
_TITLE = "(?:(?:" + "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES]) + r")\.? ){1,3}"
_NAME = r"\p{Lu}(?:\p{L}++(?:['-]\p{L}{2,})*|(?:['-]\p{L}{2,})+)"
#: A word that may be a bare mention of a name; secrets are longer.
_BARE = rf"(?=[\p{{L}}'-]{{2,15}}+(?![\p{{L}}'-])){_NAME}(?!\p{{L}})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Grouped numbers without a country's: 555-123-4567; 0171 1234567, (030) 1234567 of nine digits or more; 01 23 45 67 89
_NATIONAL_PHONE = (
    r"(?<![0-9+.-])(?:1[.-])?(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9]|[.-][0-9])"
    r"|(?<![0-9+.-])(?=\(?(?:[0-9][)]?[ ./-]?){8}[0-9])(?:0[0-9]{2,4}[ ./-]|\(0[0-9]{1,5}\) ?)[0-9]{3,8}(?:[ .-][0-9]{2,8}){0,3}(?![0-9])"
    r"|(?<![0-9+.-])0[0-9](?:[ .-][0-9]{2}){4}(?![0-9]|[.-][0-9])"
)
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "secret": r"""(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_.~+/-]{16})(?<=(?i:token|secret|passwd|password|key)["']?\s{0,2}[=:]\s{0,2}["']?)[A-Za-z0-9_.~+/-]{15,}[A-Za-z0-9_~+/-]={0,2}""",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|" + _NATIONAL_PHONE,
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}{_NAME}(?: {_NAME})*+|(?=\p{{Lu}})(?<=(?iu:{'|'.join(NAME_LABELS)})\s{{0,2}}:\s{{0,2}}){_NAME}(?: {_NAME})++",
}

def _any(*kinds: str) -> str:
    return "(?:" + "|".join(PATTERNS[k] for k in kinds) + ")"


#: Two quick looks keep the alternatives from being tried inside words.
ENTITY = r"(?<![\p{L}\p{N}])" + _any("email", "secret", "iban", "name") + "|(?=[0-9+(])" + _any("phone", "ip", "card", "national")
#: The same for texts with names, whose bare words count.
ENTITY_OR_WORD = ENTITY + r"|(?<![\p{L}\p{N}])" + _BARE
LENGTHEN, ROUNDS = 12, 60
KINDS = ("email", "secret", "iban", "phone", "ip", "card", "national", "given_m", "given_f", "given_n", "family", "family_f")


def may_hold(text: Column) -> Column:
    """Whether a text has what each kind of entity has: an at sign, a digit, a key word, a label or a title. Quick to tell."""
    titles = [*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES]
    marks = ["@", *(t for t in titles if not any(t != u and t.startswith(u) for u in titles))]
    found = text.rlike("[0-9]")
    for mark in marks:
        found = found | text.contains(mark)
    # the rare sign first, then what stands before it
    signs = rf"""[=:](?<=(?i:token|secret|passwd|password|key)["']?\s{{0,2}}[=:])|:(?<=(?iu:{'|'.join(NAME_LABELS)})\s{{0,2}}:)"""
    found = found | text.rlike(signs)
    return F.coalesce(found, F.lit(False))


def kind_keys(spark: SparkSession, key: str) -> DataFrame:
    """kind, key: a key for each kind, derived from the caller's. Rows of a table, not literals of a plan."""
    return spark.createDataFrame([(k, hmac.new(key.encode(), k.encode(), hashlib.sha256).hexdigest()) for k in KINDS], "kind string, key string")


def _shaped(part: Column, hexes: Column) -> Column:
    """The part with each digit and letter drawn anew, its case and all signs kept; other scripts' letters become Latin."""
    digits, letters = F.translate(hexes, "abcdef", "172839"), F.translate(hexes, "0123456789abcdef", "abcdefghijkmnprs")

    def one(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(128)) + 1
        low = F.substr(letters, at, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, at, F.lit(1))).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c)

    return F.array_join(F.transform(F.split(part, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    d = F.reverse(F.transform(F.split(digits, ""), lambda c: c.try_cast("int")))
    term = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
    return F.aggregate(term, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _mod97(iban: Column) -> Column:
    """An IBAN's number modulo 97: its first four signs at the end, letters from A as 10; 1 if its check digits are right."""
    turned = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _pick(words: list[str], hexes: Column, start: int) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(F.conv(F.substr(hexes, F.lit(start), F.lit(6)), 16, 10).cast("int"), F.lit(len(words))))


def with_surrogate(parts: DataFrame, keys: DataFrame) -> DataFrame:
    """parts (kind, part, draw) with the draw-th surrogate of each part. In steps, each of which stays a projection of its
    own, so that the hash is made once and generated methods stay small."""
    seed = F.concat_ws("\x1f", F.col("key"), F.col("part"), F.col("draw").cast("string"))
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f")), 256))  # 128 hexadecimal digits
    hashed = parts.join(F.broadcast(keys), "kind").withColumn("__hex", stream).drop("key")
    shaped = hashed.withColumn("__shaped", _shaped(F.col("part"), F.col("__hex")))
    made = shaped.withColumn("surrogate", _surrogate(F.col("kind"), F.col("part"), F.col("draw"), F.col("__hex"), F.col("__shaped")))
    more = F.when(F.col("draw") >= LENGTHEN, F.substr(F.translate("__hex", "abcdef", "172839"), F.lit(1), (F.col("draw") - LENGTHEN + 1).cast("int"))).otherwise("")
    named = F.col("kind").startswith("given") | F.col("kind").startswith("family") | (F.col("kind") == "email")
    return made.withColumn("surrogate", F.when(named, F.col("surrogate")).otherwise(F.concat("surrogate", more))).drop("__hex", "__shaped")


def _surrogate(kind: Column, part: Column, draw: Column, hexes: Column, shaped: Column) -> Column:
    byte = lambda i: F.conv(F.substr(hexes, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
    tail = lambda n: F.substr(shaped, F.lit(n + 1), F.greatest(F.length(part) - n, F.lit(0)))
    kept = F.length(F.regexp_extract(part, COUNTRY + "|^0|", 0))
    phone = F.concat(F.substr(part, F.lit(1), kept), F.substr(shaped, kept + 1, F.length(part)))
    ip = F.concat_ws(".", *[(F.pmod(byte(i), F.lit(254)) + 1).cast("string") for i in range(4)])
    drawn = F.concat(F.substr(part, F.lit(1), F.lit(1)), tail(1))
    body = F.substr(drawn, F.lit(1), F.length(part) - 1)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn(part) == 0, F.concat(body, check)).otherwise(drawn)
    country = F.substr(part, F.lit(1), F.lit(2))
    digits = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), tail(4)))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_mod97(part) == 1, F.concat(digits, tail(4))).otherwise(tail(2)))
    secret = F.when(part.rlike("^[0-9a-f]+$"), F.substr(F.repeat(hexes, F.ceil(F.length(part) / 128).cast("int")), F.lit(1), F.length(part))).otherwise(shaped)
    longer = F.when(draw >= LENGTHEN, F.substr(hexes, F.lit(100), (draw - LENGTHEN + 1).cast("int"))).otherwise("")
    email = F.concat(F.regexp_replace(shaped, r"\.[A-Za-z]+$", ""), longer, F.lit(".example"))
    cyrillic = part.rlike(r"\p{IsCyrillic}")

    def made(script: str) -> Column:
        long = F.array_join(F.transform(F.sequence(F.lit(1), draw.cast("int") + 2), lambda i: F.get(F.array(*map(F.lit, SYLLABLES[script])), F.conv(F.substr(hexes, i + 12, F.lit(1)), 16, 10).cast("int"))), "")
        first = _pick(FAMILY[script], hexes, 1)
        for g in "mfn":
            first = F.when(kind == f"given_{g}", _pick(GIVEN[g, script], hexes, 1)).otherwise(first)
        # later draws: made-up names; given names end by gender
        ends = {"given_f": ("na", "на"), "given_m": ("n", "н"), "given_n": ("i", "и")}
        ending = F.lit(("r", "в")[script == "cyrillic"])
        for k, e in ends.items():
            ending = F.when(kind == k, e[script == "cyrillic"]).otherwise(ending)
        # a woman's family name in Cyrillic takes its ending
        return F.concat(F.lower(F.when(draw == 0, first).otherwise(F.concat(long, ending))), F.when(kind == "family_f", "а").otherwise(""))

    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", card)
        .when(kind == "iban", iban).when(kind == "national", shaped).otherwise(F.when(cyrillic, made("cyrillic")).otherwise(made("latin")))
    )


def is_name(entity: Column) -> Column:
    return entity.rlike(f"^{_TITLE}\\p{{Lu}}") | entity.rlike(f"^{_NAME}(?: {_NAME})+$")


def kind_of(entity: Column) -> Column:
    """The kind of an entity; null for a run of 13 to 19 digits that fails the card check, which is none."""
    out = F.when(is_name(entity), "name").when(entity.rlike("^[0-9]{13,19}$"), F.when(_luhn(entity) == 0, "card"))
    for kind, shape in {"email": "@", "ip": rf"^{_OCTET}(?:\.{_OCTET}){{3}}$", "national": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "card": "^[0-9]{4}(?:[ -]?[0-9]{4}){3}$", "phone": f"^(?:{PATTERNS['phone']})$", "iban": "^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?$"}.items():
        out = out.when(entity.rlike(shape), kind)
    return out.otherwise("secret")


def name_parts(entity: Column) -> Column:
    """The words of a name with their kinds, in order: (kind, part in lower case, word)."""
    title = F.regexp_extract(entity, f"^(?:{_TITLE}|)", 0)
    woman = title.rlike("(?:^| )" + _FEMALE)
    given = F.when(woman, "given_f").when(title.rlike("(?:^| )" + _MALE), "given_m").otherwise("given_n")
    family = F.when(woman & entity.rlike(r"\p{IsCyrillic}$"), "family_f").otherwise("family")
    words = F.filter(F.split(F.substr(entity, F.length(title) + 1, F.length(entity)), " "), lambda x: x != "")

    def parts(n: Column) -> Column:
        return F.transform(n["words"], lambda x, i: F.struct(F.when(i == F.size(n["words"]) - 1, n["family"]).otherwise(n["given"]).alias("kind"), F.lower(x).alias("part"), x.alias("word")))

    # an array of one row binds words and kinds to a variable, so that they are made once for a name
    return F.get(F.transform(F.array(F.struct(words.alias("words"), given.alias("given"), family.alias("family"))), parts), F.lit(0))


def parts_of(entity: Column, bare: Column | None = None) -> Column:
    """The parts (kind, part, word) of an entity, in order: its normal form and how it is written here; none for what only
    looks like an entity. bare: the kind of a name's word that stands alone."""
    kind = kind_of(entity)
    normal = F.when(kind == "email", F.lower(entity)).when(kind == "phone", F.regexp_replace(entity, "[^0-9+]", "")).when(kind.isin("card", "national", "iban"), F.regexp_replace(entity, "[^0-9A-Z]", "")).otherwise(entity)
    single = lambda k, p: F.array(F.struct(k.alias("kind"), p.alias("part"), entity.alias("word")))
    out = F.when(kind == "name", name_parts(entity)).when(kind.isNotNull(), single(kind, normal))
    return out if bare is None else F.when(bare.isNotNull(), single(bare, F.lower(entity))).otherwise(out)


def _written(kind: Column, word: Column, surrogate: Column) -> Column:
    """A part's surrogate in the spelling of a mention."""
    plain = F.regexp_replace(surrogate, "[^0-9A-Za-z]", "")
    nth = lambda i: F.length(F.regexp_replace(F.substr(word, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    filled = F.array_join(F.transform(F.split(word, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(plain, nth(i), F.lit(1))).otherwise(c)), "")
    rest = F.substr(plain, F.length(F.regexp_replace(word, "[^0-9A-Za-z]", "")) + 1, F.length(plain))
    cased = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substr(word, i + 1, F.lit(1)).rlike(r"^\p{Lu}"), F.upper(c)).otherwise(c)), "")
    name = F.when(word.rlike(r"^[^\p{Ll}]+$") & (F.length(word) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin("phone", "card", "national", "iban"), F.concat(filled, rest)).when(kind == "email", cased).when(kind.isin("secret", "ip"), surrogate).otherwise(name)


def assign(spark: SparkSession, parts: DataFrame, key: str) -> DataFrame:
    """kind, part, surrogate for distinct (kind, part): within a kind all surrogates differ, and none equals a part."""
    keys = kind_keys(spark, key)
    real = parts.select(F.col("part").alias("surrogate")).distinct()
    now = materialise(spark, with_surrogate(parts.select("kind", "part", F.lit(0).alias("draw")), keys), "pii-draw-0")
    for step in range(1, ROUNDS):
        firsts = now.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "part")).alias("first"), F.count("*").alias("n")).where("n > 1")
        met = now.join(firsts, ["kind", "surrogate"]).where(F.struct("draw", "part") != F.col("first")).select("kind", "part")
        met = met.union(now.join(real, "surrogate", "left_semi").select("kind", "part")).distinct()
        if met.isEmpty():
            return now.select("kind", "part", "surrogate")
        again = now.join(met, ["kind", "part"], "left_semi").select("kind", "part", (F.col("draw") + 1).alias("draw"))
        moved = now.join(met, ["kind", "part"], "left_anti").unionByName(with_surrogate(again, keys))
        now, old = materialise(spark, moved, f"pii-draw-{step}"), now
        discard(old)
    raise RuntimeError(f"surrogates still meet after {ROUNDS} draws")


def pseudonymise(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """docs (text and more) with every entity of text replaced, and n_entities (how many were).

    Null and empty texts and texts without entities stay, with 0. Repeated rows get equal texts. Very long texts are
    searched and rewritten whole. An empty table gives no rows. n_chars, if there is one, follows the text; a column named
    n_entities is replaced; all others pass through.
    """
    text = F.col("text")
    k1, k2 = text_key(text)
    docs, own = docs.drop("n_entities"), own_prefix(docs)
    hint = may_hold(text)
    first = docs.where(hint).select(k1, k2, "text", F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("found")).where(F.size("found") > 0)
    plain = lambda x: F.transform(name_parts(x), lambda p: F.struct(p["kind"].alias("kind"), p["part"].alias("part")))
    named = first.withColumn("names", F.array_distinct(F.flatten(F.transform(F.filter("found", is_name), plain))))
    # a bare word counts if a name of this text has it; the name that comes first tells its kind
    every = named.withColumn("found", F.when(F.size("names") > 0, F.regexp_extract_all(text, F.lit(ENTITY_OR_WORD), F.lit(0))).otherwise(F.col("found")))
    like = lambda x: (F.size("names") > 0) & x.rlike(f"^{_BARE}$") & (F.length(x) < 16)
    as_name = lambda x: F.get("names.kind", (F.array_position("names.part", F.lower(x)) - 1).cast("int"))
    items = F.transform("found", lambda x: F.struct(x.alias("entity"), F.when(like(x), F.coalesce(as_name(x), F.lit(""))).alias("bare")))
    marks = every.select("tk1", "tk2", (F.size("names") > 0).alias("named"), items.alias("found"))
    marks = materialise(spark, marks.groupBy("tk1", "tk2").agg(F.first("found").alias("found"), F.first("named").alias("named")), "pii-marks")
    bare = F.coalesce("bare", F.lit("-"))
    entities = marks.select(F.explode("found").alias("x")).select("x.*").distinct().where(bare != "")
    parts = entities.withColumn("parts", parts_of(F.col("entity"), F.col("bare"))).select("entity", bare.alias("bare"), F.posexplode("parts").alias("i", "x"))
    parts = materialise(spark, parts.select("entity", "bare", "i", "x.*"), "pii-parts")
    given = assign(spark, parts.select("kind", "part").distinct(), key)
    title = F.regexp_extract("entity", f"^({_TITLE}|)", 1)
    spelt = parts.join(given, ["kind", "part"]).select("entity", "bare", "i", _written(F.col("kind"), F.col("word"), F.col("surrogate")).alias("s"))
    made = spelt.groupBy("entity", "bare").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"))
    made = materialise(spark, made.select("entity", "bare", F.concat(F.when(F.col("bare") == "-", title).otherwise(""), F.array_join(F.col("s.s"), " ")).alias("surrogate")), "pii-entities")
    placed = marks.select("tk1", "tk2", "named", F.posexplode("found").alias("pos", "x")).select("tk1", "tk2", "named", "pos", "x.entity", F.coalesce("x.bare", F.lit("-")).alias("bare")).join(made, ["entity", "bare"], "left")
    one = F.struct("pos", F.coalesce("surrogate", "entity").alias("s"))
    plan = placed.groupBy("tk1", "tk2", "named").agg(F.array_sort(F.collect_list(one)).alias("s"), F.count("surrogate").alias("n")).where(F.col("n") > 0)
    plan = plan.select(*[F.col(c).alias(own + c) for c in ("tk1", "tk2", "named", "n")], F.col("s.s").alias(f"{own}new"))

    t1, t2, new = f"{own}t1", f"{own}t2", F.col(f"{own}new")
    between = F.when(F.col(f"{own}named"), F.split(text, ENTITY_OR_WORD, -1)).otherwise(F.split(text, ENTITY, -1))
    pieces = F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    moved = docs.where(hint).withColumns({t1: k1, t2: k2}).join(plan, (F.col(t1) == F.col(f"{own}tk1")) & (F.col(t2) == F.col(f"{own}tk2")), "left")
    moved = moved.withColumn("n_entities", F.coalesce(F.col(f"{own}n").cast("int"), F.lit(0))).withColumn("text", F.when(new.isNotNull(), F.array_join(pieces, "")).otherwise(text))
    if "n_chars" in docs.columns:
        moved = moved.withColumn("n_chars", F.when(new.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return docs.where(~hint).withColumn("n_entities", F.lit(0)).unionByName(moved.select(*docs.columns, "n_entities"))
