"""Hand-computed values of the column rules."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed
from vacantis.functions import parsing, skills, text


def apply(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", rule(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_normalize_skill(spark):
    cases = {
        "Node.js": "nodeJs", "APIs REST": "apiRest", "C++": "c", "C#": "c", ".NET": "net", "MongoDB": "mongoDb",
        "3D Max": "3DMax", "3DMax": "3Dmax", "  ": "", "JavaScript": "javaScript", "Javascript": "javascript",
        "Resolución de problemas": "resolucionDeProblemas", None: "",
    }
    assert apply(spark, skills.normalize_skill, list(cases)) == list(cases.values())


def test_format_skill(spark):
    cases = {
        "nodeJs": "Node.js", "apiRest": "API REST", "restApi": "Rest api", "webSocket": "Websocket",
        "workManager": "Workmanager", "openAiApi": "Openai api", "mongoDb": "Mongo db", "html5Css3": "Html5css3",
    }
    assert apply(spark, skills.format_skill, list(cases)) == list(cases.values())


def test_skill_category(spark):
    cases = {"trabajoEnEquipo": "soft", "adaptabilidad": "soft", "Resolución de problemas": "technical"}
    assert apply(spark, skills.skill_category, list(cases)) == list(cases.values())


def test_normalize_skills_keeps_first_and_order(spark):
    df = spark.createDataFrame([(["C++", " ", None, "Node.js", "C#", "nodeJs"],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(skills.normalize_skills(F.col("s"))).collect()] == [["c", "nodeJs"], []]


def model_english(value):
    """Plain statement of the rule on folded text."""
    if value is None or not value.strip():
        return None
    folded = unicodedata.normalize("NFD", value.lower())
    folded = re.sub(r"\s+", " ", "".join(c for c in folded if unicodedata.category(c) != "Mn"))
    if any(re.search(p, folded) for p in fixed.ENGLISH_NEGATIVE):
        return False
    if any(re.search(p, folded) for p in fixed.ENGLISH_POSITIVE):
        return True
    return True if re.search(r"\b(ingles|english)\b", folded) else None


def test_detect_english(spark):
    cases = {
        "No requiere inglés": False, "no se requiere inglés": True, "Inglés no es indispensable": True,
        "   ": None, "nada": None, "inglesa": None, "inglesa requerida": True, "English  not\nrequired": False,
    }
    assert apply(spark, text.detect_english, list(cases)) == list(cases.values())


def test_detect_english_agrees_with_plain_model(spark):
    words = ["inglés", "INGLÉS", "íngles", "english", "not", "required", "requiere", "no", "in", "sin", "must be",
             "x", "requerido", "level", "b2", "singles", "inglesa", "_", "ñ", "\n", "x́", "english,"]
    values = [f"{a} {b} {c}" for a in words for b in words for c in words[:12]]
    values += [a + b for a in words for b in words]
    assert apply(spark, text.detect_english, values) == [model_english(v) for v in values]


def test_detect_work_mode(spark):
    cases = [
        ("Híbrido Medellín", None, "hybrid"), ("Back office Lima", None, "onsite"),
        ("Cali", "Remote contractor", "remote"), ("remoto", "presencial", "remote"), (None, None, None),
        ("HÍBRIDO", None, "hybrid"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, want string")
    out = df.select("want", text.detect_work_mode(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_extract_city(spark):
    cases = {
        "Bogotá, Colombia": "Bogotá", "California, USA": "Cali", "Santiago de Cali": "Cali", "CUCUTA": "Cúcuta",
        "Quito Presencial": None, "São Paulo ,  Brasil": "São Paulo", "": None, ", x": None, "Ciudad   Real": "Ciudad Real",
    }
    assert apply(spark, text.extract_city, list(cases)) == list(cases.values())


def test_strip_accents_is_decomposition_without_marks(spark):
    # marks younger than the JVM's Unicode tables are left out; Hangul stays composed
    points = [
        p for p in range(0x20, 0x2FA20)
        if not 0xD800 <= p <= 0xDFFF and not 0xAC00 <= p <= 0xD7A3
        and (0x300 <= p < 0x370 or unicodedata.category(chr(p)) != "Mn")
    ]
    values = ["".join(map(chr, points[i:i + 500])) for i in range(0, len(points), 500)]

    def model(v):
        return "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn")

    got = apply(spark, text.strip_accents, values)
    differing = {c for v, g in zip(values, got) if g != model(v) for c in set(g) ^ set(model(v))}
    assert len(differing) <= 2, differing


def test_location_spaces(spark):
    assert apply(spark, text.normalize_location, [" a \r\n b\x1f", " \t "]) == ["a b", None]


@pytest.mark.parametrize(("value", "want"), [
    ("Salario $ 2.500.000 mensual", 2500000), ("Pago 100", None), ("$ confidencial", None), ("$99.999.999.999", None),
])
def test_parse_salary_single(spark, value, want):
    assert apply(spark, parsing.parse_salary_single, [value]) == [want]


@pytest.mark.parametrize(("value", "want"), [
    ("$1,500 - $2.000 USD", (1500, 2000, "USD")), ("$1500", (None, None, "USD")), (".,. - 5", (None, None, "USD")),
    ("5 a 99.999.999.999", (5, None, "USD")), (None, (None, None, None)),
])
def test_parse_salary_range(spark, value, want):
    assert tuple(apply(spark, parsing.parse_salary_range, [value])[0]) == want


def test_parse_iso_timestamp(spark):
    stamp = F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))
    got = apply(spark, lambda c: parsing.parse_iso_timestamp(c, stamp), [
        "2024-05-17T10:00:00Z", "2024-05-17T22:15:00-05:00", "2024-05-17", "soon", None])
    assert [str(v) for v in got] == [
        "2024-05-17 10:00:00", "2024-05-18 03:15:00", "2024-05-17 00:00:00", "2024-06-01 00:00:00", "2024-06-01 00:00:00"]


def test_iso_timestamp_with_many_digits(spark):
    stamp = F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))
    got = apply(spark, lambda c: parsing.parse_iso_timestamp(c, stamp).cast("string"), ["2024-05-17T10:00:00.1234567Z", "2024-05-17T10:00:00.12x"])
    assert got == ["2024-05-17 10:00:00.123456", "2024-06-01 00:00:00"]


def test_detect_english_under_many_marks(spark):
    assert apply(spark, text.detect_english, ["i" + "\u0301" * 9 + "ngles", "No REQUIERE\xa0 Ingle\u0301s", "pingles"]) == [True, False, None]


def test_hangul_is_taken_apart(spark):
    texts = ["\uac00\ud7a3 \ud55c\uad6d\uc5b4 caf\u00e9 \u01d5", "\uac01\uac1c", "plain", "\u00e9", "\u1100\u1161"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip_accents(F.col("t")).alias("f")).collect()
    for r in rows:
        assert r.f == "".join(c for c in unicodedata.normalize("NFD", r.t) if unicodedata.category(c) != "Mn")


def test_cities_are_found_at_any_place_in_list_order(spark):
    folded = [text._fold(c.lower()) for c in fixed.KNOWN_CITIES]
    texts = [a + b for a in folded for b in ("", "x", " " + folded[0], folded[7])] + ["", None, "b", "calcali", "san", "Bogot\u00e1 d.c. o Cali"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.city for r in rows.select("t", text.gazetteer_match(F.col("t")).alias("city")).collect()}
    for t in texts:
        plain = text._fold((t or "").lower())
        assert got[t] == next((c for c, k in zip(fixed.KNOWN_CITIES, folded, strict=True) if k in plain), None)


def test_detect_english_in_every_spelling(spark):
    """Any character before, inside and after a phrase, against folding the whole text first."""
    hosts = ["{}english", "english{}", "x{}english", "no requiere{}ingles", "no requiere {} ingles", "in{}gles", "sin{} ingles.", "ingles{}a requerid{}o"]
    chars = [chr(p) for p in range(1, 0x3100) if unicodedata.category(chr(p)) not in ("Cn", "Cs")]
    chars += ["\u0301\u0327", "\xa0\u0301\n", "\ufb1d", "\U0001d15e", "\uac01", "\u1b06", "\u0b94", "\u212a", "\u0130"]
    values = [h.replace("{}", c) for h in hosts for c in chars]
    letters = {c: "".join(chars[ord("\xc0") - 1 :]) for c in "ngles"}
    values += [f"no requiere i{a}" for c, others in letters.items() for a in ("ngles".replace(c, o) for o in others if text._fold(o.lower()) == c)]
    values += ["requiere " * 300 + "inglesa", "English " + "x" * 5000 + "NOT\u2003 requ\u00cdred", "english not" + " " * 9000 + "required"]
    far = "y\u00e9 " * 80
    values += [far + p.replace(" ", gap) + end + far for p in ("no requiere ingles", "sin ingl\u00e9s", "not required in english", "english not required",
               "singles", "inglesa", "xinglesa requerido", "must be english", "b2 englishy") for gap in (" ", " " * 30, "\u0301\xa0" * 40) for end in ("", " ", "x", "\u0301" * 50)]
    values += [far + "requiere" + far + "inglesa", far + "inglesa" + far + "requerida", "english |" + far + "not required", "jungle " * 50 + far + "no requiere ingles" + far]

    def folded_first(c):
        spaced = {p: p.replace(" ", f"{text.SPACE}+") for p in text._PHRASES}
        letter = r"[\p{L}\p{N}_]"

        def verdict(t):
            def some(phrases, around="{}"):
                return F.array_max(F.array(*[t.rlike("(?s)" + around.replace("{}", spaced[p])) for p in phrases]))

            return (
                F.when(some(fixed.ENGLISH_NEGATIVE), F.lit(False))
                .when(some(fixed.ENGLISH_POSITIVE) | some(fixed.ENGLISH_MENTION, f"(?<!{letter}){{}}(?!{letter})"), F.lit(True))
            )

        return text.let(text.strip_accents(F.lower(c)), verdict)

    assert apply(spark, text.detect_english, values) == apply(spark, folded_first, values)


def test_detect_english_folds_only_what_lies_around_the_stem(spark):
    long = "caf\u00e9 \u00f1and\u00fa \u01d5 " * 2000
    df = spark.createDataFrame([(long + "ingl\u00e9s " + long,), ("English",), ("ingl\u00e9s" + " " * 99 + "no requerido",)], "t string")
    near = text.let(F.split("t", text._stem_as_written()), lambda parts: text._around_stems(F.col("t"), parts))
    assert [r[0] for r in df.select(F.char_length(near)).collect()] == [99, 7, 117]


def test_detect_english_beside_wide_letters(spark):
    wide = "\U0001F600 日本 é " * 60
    values = [
        f"{wide}english not required{wide}", f"{wide}siń inglés{wide}\x01",
        f"{wide}no requiere inglés", f"english required{wide}", f"{wide}English", f"\U0001F600english{wide}", "日" * 47 + "ingles" + "日" * 49,
    ]
    assert apply(spark, text.detect_english, values) == [model_english(v) for v in values]


def test_stem_is_looked_for_behind_plain_classes():
    plain, rest = text._stem_as_written().split("(?<=", 1)
    assert plain == r"[nN\x{80}-\x{10FFFF}]" and rest.startswith("[nN[")
