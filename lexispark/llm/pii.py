"""Personal data: format-preserving Feistel pseudonyms; DataFrame functions only.

Cards, IBANs and telephone numbers are read from every place where one can begin, over all lengths that end at the border
of a group; what passes its check is then looked for as it stands (longest first; of IBANs those of their country's length
before others), so what fails takes nothing from a value beside it.

Found are payment card numbers (Luhn), IBANs (97 check), telephone numbers, US social security numbers, IPv4 addresses,
dates (three formats, real days from 1900 to 2099), e-mail addresses and secrets (access keys, tokens, passwords). Numbers and dates that
fail their check stay as they are. Each value is replaced by one of the same format, by a permutation with a key:

- character strings (digits, letters): halves are added to each other, character by character within its kind (digit, small,
  capital), by a keyed hash of the other half, ROUNDS times; check digits are computed anew, separators stay in place;
- dates and addresses: a Feistel network over two unequal factors of the number of values, walked until it lands on a date.

So equal values become equal pseudonyms in all documents, different values of a kind stay different, and who has the key
can invert them. A date written in another format is the same day's pseudonym in that format.

The key is an argument or the session's setting KEY_SETTING; none is built in, and without one pseudonymise fails.

Nulls and empty texts stay; n_pii is 0. Repeated rows get equal results. Columns of docs are kept, whatever their names; n_pii
and kinds replace columns of that name. An empty table gives an empty result. Without a shuffle: every row is worked on where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import fresh

ROUNDS = 8
#: The session setting that holds the key. Keep it secret: who has it can undo the pseudonyms.
KEY_SETTING = "spark.lexispark.pii.key"
NOT_WORD = r"(?<![A-Za-z0-9_])"
#: Kinds in order of precedence where matches begin at the same place. The value of a secret is what follows its mark.
#: A name has 127 parts at most, as its registry fixes; without a bound the JVM recurses for each part of a longer one.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "access_key": NOT_WORD + r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": NOT_WORD + r"(?i:token|password|passwd|secret|api[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9]{12,64}(?![A-Za-z0-9])",
    "iban": NOT_WORD + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "dot_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9.])",
    "slash_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)[ -]?)?[0-9]{2,4}(?:[ -][0-9]{2,4}){1,4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: What stands before and after a value of the kinds whose check decides where it ends, and what ends a group of it.
CHECKED = {"iban": (NOT_WORD, "(?![A-Za-z0-9])", " "), "phone": (r"(?<![0-9+])", "(?![0-9])", "[ -]"), "card": ("(?<![0-9])", "(?![0-9])", "[ -]")}
#: Lengths of IBANs, as their registry fixes them.
IBAN_LENGTHS = {
    length: countries.split()
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
FIRST_DAY, DAYS = "1900-01-01", 73049
#: Factors whose product is the number of days, or little more; and that of addresses.
DAY_FACTORS, ADDRESS_FACTORS = (271, 270), (65536, 65536)


def _hash_number(key: str, *parts: Column | str) -> Column:
    """48 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key + ":"), *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256), 1, 12), 16, 10).cast("long")


def _added(chars: Column, stream: Column) -> Column:
    """Each character moved on within its kind by two digits of the stream."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        move = lambda first, size: F.chr(F.lit(first) + (F.ascii(c) - first + by) % size)
        return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)

    return F.transform(chars, one)


def feistel_string(value: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the ASCII strings of equal length and kinds of characters, up to 128 characters."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.split(F.substring(value, F.lit(1), half), "").alias("l"), F.split(F.substring(value, half + 1, F.length(value)), "").alias("r"))

    def turn(s: Column, n: Column) -> Column:
        stream = F.sha2(F.concat(F.lit(f"{key}:{kind}:"), n.cast("string"), F.lit(":"), F.array_join(s["r"], "")), 512)
        return F.struct(s["r"].alias("l"), _added(s["l"], stream).alias("r"))

    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], "")))
    return F.when(F.length(value) > 1, rounds).otherwise(F.array_join(_added(F.split(value, ""), F.sha2(F.lit(f"{key}:{kind}:one"), 512)), ""))


def feistel_number(value: Column, kind: str, key: str, factors: tuple[int, int]) -> Column:
    """A keyed permutation of 0 .. product of the factors - 1."""
    a, b = factors

    def turn(s: Column, n: Column) -> Column:
        left = (s["l"] + _hash_number(key, f"{kind}:", n.cast("string"), ":l:", s["r"].cast("string")) % a) % a
        return F.struct(left.alias("l"), ((s["r"] + _hash_number(key, f"{kind}:", n.cast("string"), ":r:", left.cast("string")) % b) % b).alias("r"))

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, turn, lambda s: s["l"] * b + s["r"])


def _luhn_sum(digits: Column, from_right: int) -> Column:
    """Luhn's sum of an array of digits; from_right: the place, from the right, at which the last one stands."""
    turned = F.transform(F.reverse(digits), lambda d, i: F.when((i + from_right) % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(turned, F.lit(0), lambda s, x: s + x)


def _poured(form: Column, chars: Column) -> Column:
    """form with its letters and digits replaced in order by chars."""
    out = F.aggregate(
        F.split(form, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("n")),
        lambda s, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(s["s"], F.substring(chars, s["n"], F.lit(1))).alias("s"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["n"].alias("n"))),
        lambda s: s["s"],
    )
    return out


def _card(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    body = feistel_string(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = (10 - _luhn_sum(F.split(body, ""), 1) % 10) % 10
    return F.when(_luhn_sum(F.split(digits, ""), 0) % 10 == 0, _poured(v, F.concat(body, check.cast("string"))))


def _mod97(chars: Column) -> Column:
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(chars, ""), F.lit(0), lambda s, c: F.when(value(c) > 9, s * 100 + value(c)).otherwise(s * 10 + value(c)) % 97)


def _iban(v: Column, key: str) -> Column:
    plain = F.regexp_replace(v, " ", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = feistel_string(body, "iban", key)
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1, _poured(v, F.concat(country, check, new)))


def _date(v: Column, pattern: str, key: str) -> Column:
    day = F.datediff(F.coalesce(F.try_to_timestamp(v, F.lit(pattern)).cast("date")), F.lit(FIRST_DAY).cast("date")).cast("long")
    # one step leaves the days with probability 1 in 600; twelve in a row never do in practice
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(12)), feistel_number(day, "date", key, DAY_FACTORS), lambda s, n: F.when(s >= DAYS, feistel_number(s, "date", key, DAY_FACTORS)).otherwise(s))
    return F.when(day.between(0, DAYS - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), walked.cast("int")), pattern))


def _address(v: Column, key: str) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = feistel_number(number, "ipv4", key, ADDRESS_FACTORS)
    text = F.array_join(F.transform(F.array(*[F.shiftright(new, 8 * k) % 256 for k in (3, 2, 1, 0)]), lambda x: x.cast("string")), ".")
    return F.when(F.forall(parts, lambda x: x < 256), text)


def _email(v: Column, key: str) -> Column:
    local = F.substring_index(v, "@", 1)
    return F.concat(_poured(local, feistel_string(F.regexp_replace(local, "[^A-Za-z0-9]", ""), "email", key)), F.lit("@"), F.substring_index(v, "@", -1))


def _phone(v: Column, key: str) -> Column:
    country = F.regexp_extract(v, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(v, F.length(country) + 1, F.length(v))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    return F.when(F.length(digits).between(7, 14), F.concat(country, _poured(rest, feistel_string(digits, "phone", key))))


def _ssn(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, "-", "")
    valid = ~v.rlike("^(000|666|9..)|-00-|-0000$")
    step = lambda x: feistel_string(x, "ssn", key)
    bad = "^(000|666|9..)|^...00|0000$"
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(30)), step(digits), lambda s, n: F.when(s.rlike(bad), step(s)).otherwise(s))
    return F.when(valid, _poured(v, walked))


def _secret(v: Column, key: str) -> Column:
    value = F.regexp_extract(v, "[A-Za-z0-9]+$", 0)
    return F.concat(F.substring(v, F.lit(1), F.length(v) - F.length(value)), feistel_string(value, "secret", key))


def kind_of(v: Column) -> Column:
    """The first kind whose pattern is all of v."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(v.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym; null if it isn't valid."""
    made = {
        "email": _email(v, key),
        "access_key": F.concat(F.lit("AKIA"), feistel_string(F.substring(v, F.lit(5), F.lit(16)), "access_key", key)),
        "secret": _secret(v, key),
        "iban": _iban(v, key),
        "iso_date": _date(v, "yyyy-MM-dd", key),
        "dot_date": _date(v, "dd.MM.yyyy", key),
        "slash_date": _date(v, "MM/dd/yyyy", key),
        "ipv4": _address(v, key),
        "ssn": _ssn(v, key),
        "phone": _phone(v, key),
        "card": _card(v, key),
    }
    out = F.lit(None).cast("string")
    for name, column in made.items():
        out = F.when(kind == name, column).otherwise(out)
    return out


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & (_luhn_sum(F.split(digits, ""), 0) % 10 == 0)
    if kind == "phone":
        return F.length(F.regexp_replace(F.regexp_replace(v, r"^\+[0-9]{1,3}", ""), "[^0-9]", "")).between(7, 14)
    plain = F.regexp_replace(v, " ", "")
    return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1


def readings(text: Column, kind: str) -> Column:
    """The valid values of the kind that stand anywhere in text, overlapping ones too, those to be taken first in front."""
    full, gap = PATTERNS[kind], CHECKED[kind][2]
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({full}))"), F.lit(1)))

    def shorter(v: Column) -> Column:
        groups = F.split(v, f"(?={gap})")
        return F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), ""))

    passing = F.filter(F.array_distinct(F.flatten(F.transform(longest, shorter))), lambda v: F.when(v.rlike(f"^(?:{full})$"), _valid(kind, v)).otherwise(F.lit(False)))

    def fixed(v: Column) -> Column:
        out = F.lit(False)
        for length, countries in IBAN_LENGTHS.items() if kind == "iban" else ():
            out = out | ((F.length(F.regexp_replace(v, " ", "")) == length) & F.substring(v, 1, 2).isin(countries))
        return out

    rated = F.transform(passing, lambda v: F.struct(fixed(v).alias("fixed"), F.length(v).alias("n"), v.alias("v")))
    return F.transform(F.sort_array(rated, asc=False), lambda s: s["v"])


def _pattern(text: Column) -> Column:
    """What to look for in text: PATTERNS, with valid readings in place of the checked kinds."""
    parts = []
    for kind, pattern in PATTERNS.items():
        if kind not in CHECKED:
            parts.append(F.lit(f"(?:{pattern})"))
            continue
        before, after, _ = CHECKED[kind]
        found = readings(text, kind)
        # made of letters, digits, blanks, hyphens, and of phones + and brackets; made plain for the expression
        some = F.regexp_replace(F.array_join(found, "|"), r"([+()])", r"\\$1")
        parts.append(F.when(some != "", F.concat(F.lit(f"(?:{before}(?:"), some, F.lit(f"){after})"))).otherwise(F.lit("(?!)")))
    return F.concat_ws("|", *parts)


def key_of(spark: SparkSession) -> str:
    """The session's key; an error if there is none."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        raise ValueError(f"pseudonyms need a secret key: pass one, or set {KEY_SETTING}")
    return found


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text pseudonymised by the key (default: the session's), n_pii (values replaced) and kinds (sorted)."""
    key = key or key_of(docs.sparkSession)
    docs = docs.drop("n_pii", "kinds")
    wanted, hits, made = fresh(docs, "wanted", "hits", "made")
    found = docs.withColumn(wanted, _pattern(F.col("text"))).withColumn(hits, F.regexp_extract_all("text", F.col(wanted), F.lit(0)))
    new = F.transform(hits, lambda v: F.transform(F.array(F.struct(v.alias("v"), kind_of(v).alias("kind"))), lambda s: F.struct(s["v"].alias("v"), s["kind"].alias("kind"), pseudonym(s["v"], s["kind"], key).alias("new")))[0])
    found = found.withColumn(made, F.when(F.size(hits) > 0, new))
    pieces = F.zip_with(F.split("text", F.col(wanted), -1), made, lambda p, n: F.concat(p, F.coalesce(n["new"], n["v"], F.lit(""))))
    replaced = F.filter(made, lambda n: n["new"].isNotNull())
    return found.select(
        *[F.when(F.col(made).isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(replaced), F.lit(0)).cast("long").alias("n_pii"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(replaced, lambda n: n["kind"]))), F.array().cast("array<string>")).alias("kinds"),
    )
