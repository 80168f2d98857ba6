"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in column expressions.

Found: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, payment cards (13 to 19 digits with a valid check
digit), bank account numbers (IBAN, validated), US social security numbers, calendar dates in figures or with English
month names, AWS access key ids, and the values of token, secret, key or password assignments. Each value is permuted
within its format by a Feistel network whose rounds hash the other half with the key. The same value gets the same
pseudonym in every document, different values of a format get different ones, and what is not validated stays as it is:

* digits of cards (all but the check digit, which is computed anew) and phones (without the country code) are permuted
  as digit strings; spaces, dashes and brackets stay where they are. Social security numbers are permuted again until
  they are valid ones (cycle walking), which keeps different numbers apart;
* an IBAN keeps its country, its account part is permuted within digits and capitals, its check digits are computed anew;
* hex digits of an IPv6 address are permuted where they stand;
* an IPv4 address is permuted as two halves of 16 bits;
* a date from 1600 on is permuted as a day within its 400 years: 146,097 days = 189 x 773, two halves modulo these;
* keys, tokens and the local part of e-mail addresses are permuted character by character within digits, capitals and
  small letters, secrets within other printable ASCII characters but quotes too (within hex digits, if the whole value
  is hex). Letters beyond ASCII in a local part or a secret become small ASCII letters of a hash, one way.

Text is cut at the matches, each match is rewritten, and the pieces are joined again. A match starts at the start of
a word. Digits that belong to nothing else are then searched for cards: in a run of digit groups between single spaces
or dashes, a card starts and ends with a group. Whole groups of 13 to 19 digits and groups of 4-4-4-4 or 4-6-5 digits
come first, then the longest valid row of groups (of three or more digits, but for the last one), then the whole run
as one number. Phones of three groups by spaces are searched last. Other numbers that pass the check digit by chance
are replaced too.

A secret's value reaches to the closing quote, or to white space or a quote. A password may have any length, a token,
secret or key has eight characters or more; values longer than CHUNK are permuted in pieces of so many characters.

The key is an argument, and whoever has it can reverse pseudonyms. `session_key` reads it from the session's setting
KEY_SETTING, or else makes a random one for the application. It stands in plans as a literal, so logs of plans are as
secret as the key.

Defined cases: a null text stays null, an empty one empty; both have no replacements. Rows are independent, so ties
and repeated rows get equal results. Other columns pass through.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload.llm.common import let

ROUNDS = 8
#: Session setting that holds the key; without it every Spark application has its own random one.
KEY_SETTING = "spark.meterload.pseudonyms.key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}"
IP = rf"(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{N}}]|\.\d)"
DATE = (r"(?:\d{4}-\d{2}-\d{2}(?=T\d{2})"
        r"|(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\p{L}\p{N}]))")
SSN = r"(?!000|666|9)\d{3}(?:-(?!00)\d{2}-| (?!00)\d{2} )(?!0000)\d{4}(?![\p{L}\p{N}])"
PHONE = (r"(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]?\d{3,4}"
         r"|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}"
         r"|\+(?=\d(?:[ .\-()]{0,2}\d){6})\d{1,3}(?:[ .\-]\(?\d{1,4}\)?){2,7})(?!\d)")
AWS = r"AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])"
_MONTHS = (r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?"
           r"|Nov(?:ember)?|Dec(?:ember)?)")
WRITTEN_DATE = rf"(?:\d{{1,2}} {_MONTHS} \d{{4}}|{_MONTHS} \d{{1,2}}, \d{{4}})(?![\p{{L}}\p{{N}}])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_GROUP = "[0-9A-Fa-f]{1,4}"
IP6 = (rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:[23][0-9A-Fa-f]{{3}}|[Ff][CDEcde][0-9A-Fa-f]{{2}}):(?:{_GROUP}:){{0,5}}"
       rf"(?::{_GROUP}){{1,6}})(?![\p{{L}}\p{{N}}:])")
_ASSIGNED = r"[\"']?\s{0,3}[=:]\s{0,3}"


def _value(least: str) -> str:
    """A value in quotes, or one that reaches to white space or a quote."""
    return rf"(?:\"[^\"\r\n]{least}\"|'[^'\r\n]{least}'|[\"']?[^\s\"']{least})"


SECRET = (rf"(?:(?i:password|passwd|passphrase|pwd){_ASSIGNED}{_value('+')}"
          rf"|(?i:token|secret|(?:api|access|private|secret)[_\-]?key){_ASSIGNED}{_value('{8,}')})")
#: The order decides where two kinds start at the same place.
PATTERN = rf"(?<![\p{{L}}\p{{N}}])(?:{SECRET}|{AWS}|{EMAIL}|{IBAN}|{IP6}|{IP}|{DATE}|{WRITTEN_DATE}|{SSN}|{PHONE})"
#: What PATTERN leaves: runs of digits that may hold cards, then phones of three groups by spaces.
DIGIT_RUN = r"(?<![\p{L}\p{N}])\d[\d \-]{11,}\d(?![\p{L}\p{N}])"
SPACED_PHONE = r"(?<![\p{L}\p{N}])\d{3} \d{3} \d{4}(?![\p{L}\p{N}])"
#: Characters of a value that are permuted at once.
CHUNK = 256
#: Most steps of a cycle walk: one in nine numbers is not valid, so about 10^30 walks are shorter for each that is not.
WALK = 32

_PUNCTUATION = r"!#$%&()*+,-./:;<=>?@[\]^_`{|}~"
_DIGITS, _SMALL, _CAPITAL, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Days from 1600-01-01 to 1970-01-01, and in 400 years.
_DAYS_1600, _CYCLE, _A, _B = 135140, 146097, 189, 773


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel_numbers(left: Column, right: Column, low: int, high: int, key: str, kind: str) -> Column:
    """A permutation of pairs (left modulo low, right modulo high), as a struct of l and r."""
    def turn(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        l, r = pair["l"], pair["r"]
        return F.struct(
            F.when(even, (l + _number(_digest(key, kind, i, r))) % low).otherwise(l).alias("l"),
            F.when(even, r).otherwise((r + _number(_digest(key, kind, i, l))) % high).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shifted(text: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved within its alphabet by its two digits of the digest."""
    def one(i: Column) -> Column:
        letter = F.substring(text, i, F.lit(1))
        step = F.conv(F.substring(digest, (i - 1) % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = letter
        for alphabet in alphabets:
            place = F.instr(F.lit(alphabet), letter)
            moved = F.substring(F.lit(alphabet), (place - 1 + step) % len(alphabet) + 1, F.lit(1))
            out = F.when(place > 0, moved).otherwise(out)
        return out

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise("")


def feistel_text(text: Column, key: str, kind: str, *alphabets: str) -> Column:
    """A permutation of the strings of one length and one pattern of alphabets."""
    def turn(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        l, r = pair["l"], pair["r"]
        return F.struct(
            F.when(even, _shifted(l, _digest(key, kind, i, r), alphabets)).otherwise(l).alias("l"),
            F.when(even, r).otherwise(_shifted(r, _digest(key, kind, i, l), alphabets)).alias("r"))

    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"),
                     F.substring(text, half + 1, F.length(text)).alias("r"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda p: F.concat(p["l"], p["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced in order."""
    def one(i: Column) -> Column:
        letter = F.substring(form, i, F.lit(1))
        place = F.length(_digits(F.substring(form, F.lit(1), i)))
        return F.when(letter.between("0", "9"), F.substring(digits, place, F.lit(1))).otherwise(letter)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _luhn(digits: Column, doubled_first: Column) -> Column:
    """Sum of digits with every second one doubled; `doubled_first`: 1 if the first one is."""
    def one(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((i + doubled_first) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    terms = F.transform(F.sequence(F.lit(1), F.length(digits)), one)
    return F.aggregate(terms, F.lit(0), lambda a, d: a + d)


def _valid(digits: Column) -> Column:
    # The last digit is not doubled, so the first one is if the number of digits is even.
    return F.length(digits).between(13, 19) & (_luhn(digits, F.length(digits) % 2 + 1) % 10 == 0)


def _cards(run: Column) -> Column:
    """(at, size) of the cards in a run of digits, from left to right, in characters."""
    def search(groups: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(groups))

        def joined(i: Column, k: Column | int) -> Column:
            return F.array_join(F.slice(groups, i, k), "")

        def formed(i: Column, *sizes: int) -> Column:
            same = F.transform(F.slice(groups, i, len(sizes)), F.length) == F.array(*[F.lit(n) for n in sizes])
            return same & let(joined(i, len(sizes)), _valid)

        def plain(i: Column) -> Column:
            return F.when(_valid(F.get(groups, i - 1)), 1).when(formed(i, 4, 4, 4, 4), 4).when(formed(i, 4, 6, 5), 3).otherwise(0)

        def row(i: Column) -> Column:
            def fits(k: Column) -> Column:
                return (i + k - 1 <= F.size(groups)) & (F.length(F.get(groups, i + k - 2)) > 0) & F.forall(
                    F.slice(groups, i, k - 1), lambda g: F.length(g) >= 3) & let(joined(i, k), _valid)

            return F.coalesce(F.get(F.filter(F.array(*[F.lit(k) for k in (7, 6, 5, 4, 3, 2)]), fits), F.lit(0)), F.lit(0))

        def choose(found: Column) -> Column:
            def step(now: Column, i: Column) -> Column:
                first, longest = F.get(found["plain"], i - 1), F.get(found["row"], i - 1)
                alone = ~F.exists(F.slice(found["plain"], i + 1, F.greatest(longest - 1, F.lit(0))), lambda p: p > 0)
                taken = F.when(i < now["free"], 0).when(first > 0, first).when(alone, longest).otherwise(0)

                def moved(k: Column) -> Column:
                    size = F.length(F.array_join(F.slice(groups, i, k), " "))
                    card = F.struct(now["at"].alias("at"), size.alias("size"))
                    return F.struct(
                        F.when(k > 0, i + k).otherwise(now["free"]).alias("free"),
                        (now["at"] + F.length(F.get(groups, i - 1)) + 1).alias("at"),
                        F.when(k > 0, F.array_append(now["cards"], card)).otherwise(now["cards"]).alias("cards"))

                return let(taken, moved)

            start = F.struct(F.lit(1).alias("free"), F.lit(1).alias("at"),
                             F.expr("CAST(array() AS ARRAY<STRUCT<at: INT, size: INT>>)").alias("cards"))
            return F.aggregate(every, start, step, lambda now: now["cards"])

        def or_whole(cards: Column) -> Column:
            whole = (F.size(cards) == 0) & ~F.array_contains(groups, "") & (F.size(groups) <= 19) & let(
                F.array_join(groups, ""), _valid)
            return F.when(whole, F.array(F.struct(F.lit(1).alias("at"), F.length(run).alias("size")))).otherwise(cards)

        found = F.struct(F.transform(every, plain).alias("plain"), F.transform(every, row).alias("row"))
        return let(let(found, choose), or_whole)

    return let(F.split(run, "[ \\-]", -1), search)


def _card(m: Column, key: str) -> Column:
    def body(digits: Column) -> Column:
        front = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", _DIGITS)

        def checked(new: Column) -> Column:
            check = (10 - _luhn(new, F.length(new) % 2) % 10) % 10
            return F.concat(new, check.cast("string"))

        return F.when(_valid(digits), let(let(front, checked), lambda new: _filled(m, new))).otherwise(m)

    return let(_digits(m), body)


def _plain_digits(m: Column, key: str, kind: str) -> Column:
    return let(feistel_text(_digits(m), key, kind, _DIGITS), lambda new: _filled(m, new))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(\-])", 0)
    return let(country, lambda c: F.concat(
        c, let(F.substring(m, F.length(c) + 1, F.length(m)), lambda rest: _plain_digits(rest, key, "phone"))))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))

    def body(o: Column) -> Column:
        new = feistel_numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return let(new, lambda p: F.concat_ws(".", *[
            part.cast("string") for half in (p["l"], p["r"]) for part in (F.floor(half / 256), half % 256)]))

    return let(octets, body)


def _date(m: Column, key: str) -> Column:
    def permuted(day: Column) -> Column:
        number = F.unix_date(day) + _DAYS_1600
        within = number % _CYCLE
        new = feistel_numbers(F.floor(within / _B), within % _B, _A, _B, key, "date")
        return let(new, lambda p: F.date_from_unix_date(
            (number - within + p["l"] * _B + p["r"] - _DAYS_1600).cast("int")))

    out = m
    for shape, form in (
        (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
        (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"), (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"),
        (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"), (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
        (r"\d{1,2} [A-Z][a-z]{2} \d{4}", "d MMM yyyy"), (r"[A-Z][a-z]{2} \d{1,2}, \d{4}", "MMM d, yyyy"),
        (r"\d{1,2} [A-Z][a-z]+ \d{4}", "d MMMM yyyy"), (r"[A-Z][a-z]+ \d{1,2}, \d{4}", "MMMM d, yyyy"),
    ):
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        usable = m.rlike(f"^{shape}$") & day.isNotNull() & (F.year(day) >= 1600)
        out = F.when(usable, F.date_format(permuted(day), form)).otherwise(out)
    return out


def _ascii_text(value: Column, key: str, kind: str, *alphabets: str) -> Column:
    """`feistel_text`; letters beyond ASCII become letters of a hash of the value, and the rest is a permutation."""
    plain = F.regexp_replace(value, r"[^\p{ASCII}]", "x")
    mixed = F.concat(F.translate(F.substring(_digest(key, "letters", F.lit(0), value), 1, 8), _HEX, _SMALL[:16]), plain)
    return F.when(value.rlike(r"^\p{ASCII}*$"), feistel_text(value, key, kind, *alphabets)).otherwise(
        F.substring(feistel_text(mixed, key, kind, *alphabets), F.length(mixed) - F.length(value) + 1, F.length(value)))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(
        _ascii_text(local, key, "email", _DIGITS, _SMALL, _CAPITAL), F.substring(m, F.length(local) + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^[^=:]*[=:]\s*[\"']?", 0)
    close = F.regexp_extract(m, r"[\"']$", 0)

    def body(value: Column) -> Column:
        def chunks(kind: str, *alphabets: str) -> Column:
            parts = F.regexp_extract_all(value, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
            return F.array_join(F.transform(parts, lambda part: _ascii_text(part, key, kind, *alphabets)), "")

        return F.when(value.rlike("^[0-9a-f]+$"), chunks("hex", _HEX)).otherwise(
            chunks("secret", _DIGITS, _SMALL, _CAPITAL, _PUNCTUATION))

    return let(name, lambda n: F.concat(
        n, let(F.substring(m, F.length(n) + 1, F.length(m) - F.length(n) - F.length(close)), body), close))


def _ssn(m: Column, key: str) -> Column:
    """Permuted until it is a valid number again: a walk along the cycle that the number lies on."""
    def step(now: Column, i: Column) -> Column:
        again = (i == 1) | ~F.regexp_replace(now, r"^(...)(..)(....)$", "$1-$2-$3").rlike(f"^(?:{SSN})$")
        return F.when(again, feistel_text(now, key, "ssn", _DIGITS)).otherwise(now)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _digits(m), step)
    return let(walked, lambda new: _filled(m, new))


def _mod_97(account: Column) -> Column:
    """The remainder of letters and digits, A being 10, B 11 and so on."""
    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(account, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    def body(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)

        def numbered(account: Column) -> Column:
            check = F.lpad((98 - _mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, account)

        valid = F.length(plain).between(15, 34) & (
            _mod_97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)
        account = feistel_text(F.substring(plain, F.lit(5), F.length(plain)), key, "iban", _DIGITS, _CAPITAL)
        return F.when(valid, let(let(account, numbered), lambda new: _spaced(m, new))).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), body)


def _spaced(form: Column, letters: Column) -> Column:
    """`letters` with spaces where `form` has them."""
    def one(i: Column) -> Column:
        place = F.length(F.replace(F.substring(form, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.when(F.substring(form, i, F.lit(1)) == " ", " ").otherwise(F.substring(letters, place, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _ip6(m: Column, key: str) -> Column:
    """Equal addresses written alike stay linked; the first digit stays, so that the address stays one of its kind."""
    rest = feistel_text(F.substring(m, F.lit(3), F.length(m)), key, "ip6", _DIGITS + _SMALL[:6], _CAPITAL[:6])
    return F.concat(F.substring(m, 1, 2), rest)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; the match itself if it is not valid."""
    full = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return (
        F.when(full(SECRET), _secret(m, key))
        .when(full(AWS), F.concat(F.lit("AKIA"), feistel_text(F.substring(m, 5, 64), key, "aws", _DIGITS, _CAPITAL)))
        .when(full(EMAIL), _email(m, key)).when(full(IP), _ip(m, key))
        .when(full(IBAN), _iban(m, key)).when(full(IP6), _ip6(m, key))
        .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})$") | full(WRITTEN_DATE), _date(m, key))
        .when(full(SSN), _ssn(m, key)).otherwise(_phone(m, key)))


def _piece(text: Column, new: Column | None = None) -> Column:
    return F.struct(text.alias("m"), (F.lit(None).cast("string") if new is None else new).alias("new"))


def _cut(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """The pieces of a text: what lies between matches, and each match as the pieces that `rewrite` makes of it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.when(
        m.isNull(), F.array(_piece(gap))).otherwise(F.concat(F.array(_piece(gap)), rewrite(m)))))


def _cut_rest(pieces: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """`pieces`, those without a replacement cut once more."""
    return F.flatten(F.transform(pieces, lambda p: F.when(
        p["new"].isNull() & p["m"].rlike(pattern), _cut(p["m"], pattern, rewrite)).otherwise(F.array(p))))


def _run_pieces(run: Column, key: str) -> Column:
    def body(cards: Column) -> Column:
        def one(card: Column, i: Column) -> Column:
            before = F.get(cards, i - 1)
            start = F.when(i > 0, before["at"] + before["size"]).otherwise(1)
            return let(F.substring(run, card["at"], card["size"]), lambda m: F.array(
                _piece(F.substring(run, start, card["at"] - start)), _piece(m, _card(m, key))))

        last = F.get(cards, F.size(cards) - 1)
        tail = F.array(_piece(F.substring(run, last["at"] + last["size"], F.length(run))))
        return F.when(F.size(cards) == 0, F.array(_piece(run))).otherwise(
            F.concat(F.flatten(F.transform(cards, one)), tail))

    return let(_cards(run), body)


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting; without one, a random key that holds for this application."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str, column: str = "text", count: str | None = None) -> DataFrame:
    """`docs` with personal data in `column` replaced; `count` names a column for the number of replacements."""
    text = F.col(column)
    pieces = _cut(text, PATTERN, lambda m: F.array(_piece(m, pseudonym(m, key))))
    pieces = _cut_rest(pieces, DIGIT_RUN, lambda run: _run_pieces(run, key))
    pieces = _cut_rest(pieces, SPACED_PHONE, lambda m: F.array(_piece(m, _phone(m, key))))
    work = "_pseudonym_pieces"
    out = docs.withColumn(work, F.when(text.rlike("[0-9@=:]"), pieces))
    joined = F.array_join(F.transform(F.col(work), lambda p: F.coalesce(p["new"], p["m"])), "")
    changed = F.size(F.filter(F.col(work), lambda p: p["new"] != p["m"]))
    columns = [F.coalesce(joined, text).alias(column) if c == column else F.col(f"`{c}`") for c in docs.columns]
    if count:
        columns.append(F.when(F.col(work).isNull(), 0).otherwise(changed).cast("long").alias(count))
    return out.select(*columns)
