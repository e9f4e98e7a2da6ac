import re

from pyspark.sql import functions as F

from tablewright.llm import surrogate

TEXT = (
    'Mail ana.b@mail.example.com or +1 (974) 555-3436; host 97.51.17.173. Card 4111 1111 1111 1111, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" '
    "Mr. John Smith met Frau Anna Smith and г-жа Анна Петрова. IBAN DE89370400440532013000, no 123-45-6789. Plain 12 words of 2024."
)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def card(i):
    body = f"{400000000000000 + i * 7919}"
    return next(body + c for c in "0123456789" if luhn(body + c))


def run(spark, rows, key="k"):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_entities": F.lit("old"), "entity": F.lit(1), "tk1": F.lit("clash")})
    return surrogate.pseudonymise(spark, df, key).collect()


def test_formats(spark):
    out = run(spark, [(1, TEXT)])[0]
    assert out.n_entities == 10
    shape = re.fullmatch(
        r'Mail ([a-z]+\.[a-z]@[a-z]+\.[a-z]+\.example) or \+1 (\(\d{3}\) \d{3}-\d{4}); host (\d+\.\d+\.\d+\.\d+)\. Card (\d{4} \d{4} \d{4} \d{4}), token = "([0-9a-f]{40})" '
        r"Mr\. (\w+) (\w+) met Frau (\w+) (\w+) and г-жа ([А-я]+) ([А-я]+)\. IBAN (DE\d{20}), no (\d{3}-\d{2}-\d{4})\. Plain 12 words of 2024\.",
        out.text,
    )
    assert shape, out.text
    assert shape[7] == shape[9] and shape[6] in surrogate.GIVEN["m", "latin"] and shape[8] in surrogate.GIVEN["f", "latin"] and mod97(shape[12]) == 1
    assert luhn(shape[4]) and shape[4] != "4111 1111 1111 1111" and all(0 < int(o) < 256 for o in shape[3].split("."))
    assert shape[11].endswith("ва") and not {"ana.b", "John", "Smith", "Anna"} & set(re.findall(r"[\w.]+", out.text))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no entity, 7 words or so @ all"), (4, TEXT), (4, TEXT), (None, TEXT), (5, "x " * 60_000 + TEXT + " y" * 60_000), (6, "10.0.0.1" + " 10.0.0.1" * 500)]
    out = run(spark, rows)
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == [rows[2][1]]
    assert by[4][0] == by[4][1] == by[None][0] and by[5][0].strip("xy ") == by[4][0].strip("xy ")
    assert len(set(by[6][0].split())) == 1
    assert run(spark, [(1, TEXT)], "other")[0].text != by[4][0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert surrogate.pseudonymise(spark, empty, "k").count() == 0


def test_distinct_entities_stay_distinct(spark):
    """Far more names than the lists hold, so that first draws meet."""
    syl = ["an", "ber", "co", "dal", "es", "fro", "gil", "hu"]
    names = [(a + b + c).capitalize() for a in syl for b in syl for c in syl]
    rows = [(i, f"Herr {n} wohnt hier. Karte {card(i)}") for i, n in enumerate(names)]
    out = {r.doc_id: r.text for r in run(spark, rows)}
    new = [re.fullmatch(r"Herr (\w+) wohnt hier\. Karte (\d{16})", out[i]).groups() for i in range(len(names))]
    for old, made in ((names, [n for n, _ in new]), ([t[-16:] for _, t in rows], [c for _, c in new])):
        assert len(set(made)) == len(set(old)) and not set(made) & set(old)


def test_parts(spark):
    df = spark.createDataFrame([("Mrs Ann Lee",), ("a@b.co",), ("1.2.3.4",), ("+49 30 1234567",), ("4111111111111111",)], "e string")
    kinds = [[p["kind"] for p in r[0]] for r in df.select(surrogate.parts_of(F.col("e"))).collect()]
    assert kinds == [["given_f", "family"], ["email"], ["ip"], ["phone"], ["card"]]


def test_spellings_of_one_thing_stay_one(spark):
    """Brute force over spellings: equal normal forms, and they alone, have equal surrogates, written as the mention is."""
    digits = lambda t: re.sub("[^0-9]", "", t)
    texts = [
        "+1 555 123 4567", "+1-555-123-4567", "+1 (555) 123-4567", "+15551234567", "+1 555 123 4568", "+49 30 1234567", "+49 301 234567", "A.Lee@b.com", "a.lee@B.com", "a.lee@c.com",
        "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4012 8888 8888 1881", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32",
    ]
    out = [r.text.split(": ")[1] for r in sorted(run(spark, [(i, f"here: {t}") for i, t in enumerate(texts)]), key=lambda r: r.doc_id)]
    normal = lambda t: t.lower() if "@" in t else re.sub("[^0-9A-Z+]", "", t)
    for a, x in zip(texts, out, strict=True):
        assert normal(a) != normal(x) and ("@" in a or re.sub("[0-9A-Z]", "#", a) == re.sub("[0-9A-Z]", "#", x)), (a, x)
        for b, y in zip(texts, out, strict=True):
            assert (normal(a) == normal(b)) == (normal(x) == normal(y)), (a, b, x, y)
    assert all(x.startswith("+1") for x in out[:5]) and all(x.startswith("+49") for x in out[5:7]) and out[7][0].isupper() and out[8][0].islower()
    assert all(luhn(digits(x)) for x in out[10:14]) and mod97(normal(out[14])) == mod97(normal(out[16])) == 1 and out[16][:2] == "GB"


def test_names_in_all_their_mentions(spark):
    rows = [
        (1, "Mr John Smith came. Smith, John's friend and SMITH again; a smith, Smithson and Johnny stay. Will came too."), (2, "Smith alone is a word here, and John."), (3, "Mr SMITH saw Mr Smith."),
        (4, "Prof. Dr. Anna Maria Lee wrote; Maria did. Name: Peter Jones, Name: unknown"), (5, "Frau Dr. Eva Braun und Dr. Braun"), (6, "г-жа Анна Петрова и Петрова, г-н Иван Петров"),
    ]
    out = {r.doc_id: r for r in run(spark, rows)}
    one = re.fullmatch(r"Mr (\w+) (\w+) came\. (\w+), (\w+)'s friend and (\w+) again; a smith, Smithson and Johnny stay\. Will came too\.", out[1].text)
    assert one and one[2] == one[3] == one[5].capitalize() and one[5].isupper() and one[1] == one[4] and out[1].n_entities == 4
    assert out[2].text == rows[1][1] and out[2].n_entities == 0
    three = re.fullmatch(r"Mr (\w+) saw Mr (\w+)\.", out[3].text)
    assert three[1] == three[2].upper() and three[2] == one[2]
    four = re.fullmatch(r"Prof\. Dr\. (\w+) (\w+) (\w+) wrote; (\w+) did\. Name: (\w+) (\w+), Name: unknown", out[4].text)
    assert four and four[2] == four[4] and four[1] in surrogate.GIVEN["n", "latin"]
    five = re.fullmatch(r"Frau Dr\. (\w+) (\w+) und Dr\. (\w+)", out[5].text)
    assert five and five[1] in surrogate.GIVEN["f", "latin"] and five[2] == five[3]
    six = re.fullmatch(r"г-жа (\w+) (\w+) и (\w+), г-н (\w+) (\w+)", out[6].text)
    assert six and six[2] == six[3] and six[2].endswith("ва") and not six[5].endswith("а")


def test_what_only_looks_like_an_entity_stays(spark):
    rows = [(1, "order 1234567890123, at 20240101123456, id 9807915762804491 and Herr Meyer"), (2, "order 1234567890123 alone")]
    out = {r.doc_id: r for r in run(spark, rows)}
    assert out[1].n_entities == 1 and out[1].text.startswith(rows[0][1][:-5]) and "Meyer" not in out[1].text and out[2].text == rows[1][1] and out[2].n_entities == 0


def test_a_format_that_is_used_up(spark):
    """All numbers of a format occur: surrogates get longer rather than meet."""
    parts = spark.createDataFrame([("national", f"{i:02}") for i in range(100)], "kind string, part string")
    got = surrogate.assign(spark, parts, "k").collect()
    real = {r.part for r in got}
    assert len({r.surrogate for r in got}) == 100 and not {r.surrogate for r in got} & real


def test_the_key_is_in_no_plan(spark):
    parts = spark.createDataFrame([("ip", "1.2.3.4", 0)], "kind string, part string, draw int")
    made = surrogate.with_surrogate(parts, surrogate.kind_keys(spark, "very secret key"))
    keys = [r.key for r in surrogate.kind_keys(spark, "very secret key").collect()]
    plan = made._jdf.queryExecution().toString()
    assert "very secret key" not in plan and not any(k in plan for k in keys)


def test_whole_entities(spark):
    """Nothing of an entity stays, however long it is and whatever its form."""
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    texts = {
        f"token={'Zq7' * 100}": ["Zq7" * 3], f"secret: {'0a1b' * 200} end": ["0a1b0a1b"], f"key = {jwt}. Next": jwt.split("."), "key=ab+cdEFGHIJ/KLMNOP12345==": ["ab+cd", "KLMNOP"],
        "Password: Hunter2Hunter2Hunter2": ["Hunter2"], "API_KEY=ABCDEFGHIJKLMNOP1234": ["ABCDEFGH"], "Mrs Anna Maria Schmidt left": ["Anna", "Maria", "Schmidt"],
        f"Mr {'Abc' * 20} left": ["Abc"], "call 555-123-4567 now": ["555-123-4567"], "ruf 0171 1234567 an": ["1234567"], "ruf (030) 1234567 an": ["1234567"], "le 01 23 45 67 89.": ["23 45 67"],
    }
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in run(spark, rows)}
    for i, t in rows:
        assert out[i].n_entities == 1 and not [x for x in texts[t] if x in out[i].text], (t, out[i].text)
        assert out[i].text.split(" ")[0].split("=")[0] == t.split(" ")[0].split("=")[0]
        assert len(out[i].text) == len(t) or t.startswith("M")
    assert out[2].text.endswith(". Next") and out[1].text.endswith(" end") and out[6].text.endswith(" left")
    plain = [(1, "In 01-2024 and 05/2023 it rose by 0.123456789 to 1,234,567, see 10.1000/182 and ISO 2022-01-02."), (2, "The key word: none."), (3, "Mr " + "Abc " * 20_000)]
    same = {r.doc_id: r for r in run(spark, plain)}
    assert [same[1].n_entities, same[2].n_entities, same[3].n_entities] == [0, 0, 1] and "Abc" not in same[3].text
