"""Format-preserving Feistel pseudonyms for personal numbers and dates.

Values are found by pattern and validated: IPv4 octets and calendar dates must be in range, card numbers must have
the Luhn sum, social security numbers an area, group and serial that can be issued; what fails is left alone. Each is replaced by a keyed permutation of its own format: an alternating Feistel network
over the decimal digits (over 32 bits for addresses; over day numbers with cycle walking for dates), so equal
values stay linked across documents while layout and validity stay. Mail addresses, which are not numbers, get a
keyed digest as their name. Only DataFrame functions are used, row by row: nothing is shuffled.

Whoever has the key can undo the permutation. The queries take it from the session's setting KEY_SETTING; where that is unset,
as in tests, a public one is used, which protects nothing.

Defined cases: null text stays null; texts without such values are unchanged; repeated rows give equal rows;
an empty table gives an empty result; all other columns pass through `pseudonymised` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm._shared import fresh, table

KEY_SETTING = "spark.stockloom.pseudonyms.key"
KEY = "public-test-key"
ROUNDS = 8
MAIL = r"(?<![\w.+-])[\w.+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+"
ADDRESS = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<!\w)(?:\d{13,19}|\d{4}(?: \d{4}){3}(?: \d{1,3})?|\d{4}(?:-\d{4}){3}(?:-\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|\.\d)"
PATTERNS = {"mail": MAIL, "address": ADDRESS, "date": DATE, "social": SOCIAL, "card": CARD, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31


def _prf(key: str, tag: Column, i: Column, half: Column, modulus: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def _feistel(a: Column, b: Column, m_a: Column, m_b: Column, tag: Column, key: str) -> Column:
    """The pair after ROUNDS (even, so each half ends where it began) rounds; a below m_a, b below m_b."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda s, i: F.struct(
            s["b"].alias("a"),
            F.pmod(s["a"] + _prf(key, tag, i, s["b"], F.when(i % 2 == 0, m_a).otherwise(m_b)), F.when(i % 2 == 0, m_a).otherwise(m_b)).alias("b"),
        ),
    )


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permuted_digits(digits: Column, key: str = KEY, tag: str = "n") -> Column:
    """A keyed permutation of the decimal strings of each length from 2 to 30."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    pair = _feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v), power(u), power(v), F.concat(F.lit(tag), F.length(digits)), key)
    return _let(pair, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))


def _luhn_digit(head: Column) -> Column:
    """The digit that completes head to a sum divisible by ten."""
    total = F.aggregate(
        F.transform(
            F.filter(F.split(F.reverse(head), ""), lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def _refilled(layout: Column, digits: Column) -> Column:
    """layout with its digits replaced in order."""
    gaps = F.split(layout, "[0-9]", -1)
    return F.array_join(F.zip_with(gaps, F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1))), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")


def _number(m: Column, key: str, tag: str) -> Column:
    return _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: _refilled(m, permuted_digits(d, key, tag)))


def _social(m: Column, key: str) -> Column:
    """Cycle walking keeps to the numbers that can be issued."""
    sound = lambda d: d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$")

    def body(d: Column) -> Column:
        walked = F.aggregate(F.sequence(F.lit(0), F.lit(200)), d, lambda v, i: F.when((i > 0) & sound(v), v).otherwise(permuted_digits(v, key, "social")))
        return F.when(sound(d), _refilled(m, walked)).otherwise(m)

    return _let(F.regexp_replace(m, "[^0-9]", ""), body)


def _card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        n = F.length(d)
        head = F.substring(d, F.lit(1), n - 1)
        valid = _luhn_digit(head) == F.substring(d, n, F.lit(1))
        kept = _let(permuted_digits(head, key, "luhn"), lambda h: F.concat(h, _luhn_digit(h)))
        return F.when(valid, _refilled(m, kept)).otherwise(m)

    return _let(F.regexp_replace(m, "[^0-9]", ""), body)


def _address(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        octet = lambda i: F.get(o, F.lit(i)).cast("long")
        pair = _feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
        at = lambda s, h: [F.floor(s[h] / 256).cast("string"), (s[h] % 256).cast("string")]
        moved = _let(pair, lambda s: F.concat_ws(".", *at(s, "a"), *at(s, "b")))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), moved).otherwise(m)

    return _let(F.split(m, r"\."), body)


def _date(m: Column, key: str) -> Column:
    form = F.when(m.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(m.rlike("/"), "d/M/yyyy").otherwise("d.M.yyyy")
    day = F.coalesce(
        *[F.when(form == f, F.to_date(F.try_to_timestamp(m, F.lit(f)))) for f in ("yyyy-MM-dd", "d/M/yyyy", "d.M.yyyy")],
        F.when(form == "d/M/yyyy", F.to_date(F.try_to_timestamp(m, F.lit("M/d/yyyy")))),
    )
    month_first = F.when(form == "d/M/yyyy", F.try_to_timestamp(m, F.lit("d/M/yyyy")).isNull()).otherwise(F.lit(False))
    step = lambda v: permuted_digits(F.lpad(v.cast("string"), 5, "0"), key, "date").cast("int")

    def body(d: Column) -> Column:
        start = F.datediff(d, F.lit(FIRST_DAY))
        walked = F.aggregate(F.sequence(F.lit(0), F.lit(80)), F.lit(-1), lambda v, i: F.when((i > 0) & (v < DAYS), v).otherwise(step(F.when(i == 0, start).otherwise(v))))
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), walked)
        wide = m.rlike(r"^\d{2}[/.]\d{2}")
        text = F.when(form == "yyyy-MM-dd", F.date_format(new, "yyyy-MM-dd"))
        for f, p, q in (("d/M/yyyy", "dd/MM/yyyy", "d/M/yyyy"), ("d.M.yyyy", "dd.MM.yyyy", "d.M.yyyy")):
            if "/" in f:
                text = text.when((form == f) & month_first, F.when(wide, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "M/d/yyyy")))
            text = text.when(form == f, F.when(wide, F.date_format(new, p)).otherwise(F.date_format(new, q)))
        return F.when(d.isNull() | (start < 0) | (start >= DAYS), m).otherwise(text)

    return _let(day, body)


def _mail(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key), F.lit("|mail|"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def _kind(m: Column) -> Column:
    whole = lambda name: m.rlike(f"^(?:{PATTERNS[name]})$")
    out = F.when(whole("mail"), "mail")
    for name in list(PATTERNS)[1:]:
        out = out.when(whole(name), name)
    return out.otherwise("none")


def pseudonym(m: Column, kind: Column, key: str = KEY) -> Column:
    return (
        F.when(kind == "mail", _mail(m, key)).when(kind == "address", _address(m, key)).when(kind == "date", _date(m, key))
        .when(kind == "social", _social(m, key)).when(kind == "card", _card(m, key)).when(kind == "phone", _number(m, key, "phone")).otherwise(m)
    )


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text", found: str = "found") -> DataFrame:
    """docs with text replaced, and with one more column, the array `found` of (kind, value, pseudonym)."""
    if found in docs.columns:
        raise ValueError(f"docs has a column {found}")
    t = F.col(text)
    matches = F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda m: F.struct(_kind(m).alias("kind"), m.alias("value")))
    matches = F.transform(matches, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), pseudonym(s["value"], s["kind"], key).alias("pseudonym")))
    df = docs.withColumn(found, F.when(t.rlike(ANY), matches))
    new = F.array_join(F.zip_with(F.split(t, ANY, -1), found, lambda gap, s: F.concat(gap, F.coalesce(s["pseudonym"], F.lit("")))), "")
    return df.withColumn(text, F.when(F.col(found).isNull(), t).otherwise(new))


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or KEY


def pseudonymise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: docs with pseudonyms in their texts; n_chars, where it is a column, follows."""
    (found,) = fresh(docs, "found")
    df = pseudonymised(docs, key_of(spark), found=found)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    changed = lambda k: F.size(F.filter(F.coalesce("found", F.array().cast(df.schema["found"].dataType)), lambda s: (s["kind"] == k) & (s["value"] != s["pseudonym"]))).cast("long")
    return df.select("doc_id", "text", *[changed(k).alias(f"n_{k}") for k in PATTERNS])
