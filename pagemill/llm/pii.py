"""Personal data replaced by surrogates. Native plans only.

Entities are found by one pattern and checked by kind. Every distinct entity gets a surrogate from a keyed hash, of
the same kind, script, gender and format. Checks over the table of distinct entities find surrogates that two
entities share, or that some real entity has; those are drawn again until there are none. So equal entities stay
equal everywhere, different ones stay different, and no surrogate is somebody's data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Titles and the gender of the given names after them.
MALE = "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|Signor|श्री"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Signora|श्रीमती|सुश्री"
NEUTRAL = "Dr|Prof"
#: How issuers' tokens begin.
_ISSUED = r"(?:sk-|rk-|(?:sk|pk|rk)_(?:live|test)_|gh[oprsu]_|github_pat_|glpat-|xox[abeprs]-|AKIA|ASIA|AIza|eyJ)"
#: A word of a name: parts joined by apostrophes or hyphens, without a genitive's s; nothing that an entity could begin with is joined.
_WORD = rf"[\p{{Lu}}\p{{Lo}}][\p{{L}}\p{{M}}]*+(?:['’-](?!s(?![\p{{L}}\p{{M}}])|{_ISSUED})[\p{{L}}\p{{M}}]++(?![\p{{N}}@._+%]|-(?!\p{{L}})))*+"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])"
#: Key blocks, tokens by the prefixes that their issuers document, bare hexadecimal keys.
BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s:,.]++|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
TOKEN = rf"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{{16}}|{_ISSUED}(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{{16,512}}(?:\.[A-Za-z0-9_-]{{4,2048}}){{0,2}}+)(?![A-Za-z0-9_-])"
SECRET = r"(?<![A-Za-z0-9])(?=[a-f0-9]*[0-9])(?:[a-f0-9]{32,128}|[A-F0-9]{32,128})(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
LONG_ADDRESS = rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
_CALL = r"(?<=(?:tel|phone|mobile|cell|call|fax|Tel|Phone|Mobile|Cell|Call|Fax|TEL)[.:]{0,2} {0,2})"
PHONE = rf"(?<![\p{{L}}\d+])\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?[ .-]?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}(?!\d)|(?<![\d+])\(\d{{3}}\) ?\d{{3}}[-. ]\d{{4}}(?!\d)|(?<![\d.-])\d{{3}}[-.]\d{{3}}[-.]\d{{4}}(?![\d-])|{_CALL}\d{{10}}(?!\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: In one piece or in the groups that cards have, so that a number before a card is not taken for its beginning.
CARD = r"(?<![\d.-])(?:\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{1,4}|\d{4}(?<wide>[ -])\d{6}\k<wide>\d{4,5})(?![\d-])"
NAME = rf"(?<![\p{{L}}\p{{M}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.?+ {_WORD}(?: {_WORD}){{0,2}}"
#: What begins a word, then what begins with a digit or a sign: one look at the characters around a place rules out most places.
PATTERN = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join((EMAIL, TOKEN, SECRET, IBAN, LONG_ADDRESS, NAME))})|(?=[0-9+(-])(?:{'|'.join((ADDRESS, PHONE, SOCIAL, CARD, BLOCK))})"
#: Capitalised words too, which can be names known from elsewhere in a text; and words in lower case.
WIDE = rf"{PATTERN}|(?<![\p{{L}}\p{{M}}\p{{N}}]){_WORD}(?![\p{{L}}\p{{M}}\p{{N}}])"
_SMALL = r"(?<![\p{L}\p{M}\p{N}])\p{Ll}[\p{L}\p{M}]*+"
_TITLED = rf"(?=[A-Zशस])(?<![\p{{L}}\p{{M}}])(?:{MALE}|{FEMALE}|{NEUTRAL})\.? "

#: Syllables of surrogate names, by script (fixed values, to be read in step: equal places sound alike).
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa so ta te to va ve vo za".split(),
    "devanagari": "बा बे बो दा दे दो फा फे गा गो का के को ला ले लो मा मे मो ना ने नो पा पे पो रा रे रो सा सो ता ते तो वा वे वो जा".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са со та те то ва ве во за".split(),
}
#: Ends of surrogate names: male and female given names, given names of either, family names.
ENDS = {"latin": ["n", "lia", "r", "ski"], "devanagari": ["न", "वती", "र", "कर"], "cyrillic": ["н", "лия", "р", "ский"]}
ROUNDS = 64
#: Attempts in the form of the entity alone; after them its surrogates grow with the attempt.
PLAIN = 3


def _may(text: Column) -> Column:
    """Every entity has a digit, an at sign or a title, or is a key block or a token; other texts are passed on at once."""
    return text.rlike("[0-9@]") | text.contains("PRIVATE KEY") | text.contains("AKIA") | text.contains("ASIA") | text.rlike(_TITLED)


def _kind(hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"\D", "")
    octets = F.transform(F.split(hit, r"\."), lambda x: x.cast("int"))
    issuer = digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|6011|64|65|35|62|5[06-8]|6[07])")
    return (
        F.when(hit.contains("@"), "email")
        .when(hit.rlike(rf"^(?:{MALE}|{FEMALE}|{NEUTRAL})[. ]"), "name")
        .when(hit.startswith("-----"), "block")
        .when(hit.rlike(f"^{_ISSUED}"), "token")
        .when(hit.rlike("^[0-9a-fA-F]{32,128}$"), "secret")
        .when(hit.rlike("^[A-Z]{2}[0-9]"), F.when((F.length(_bare(hit)) >= 15) & (_mod97(_bare(hit)) == 1), "iban"))
        .when(hit.contains(":"), F.when(hit.rlike("[0-9]"), "long_address"))
        .when(hit.rlike(rf"^{ADDRESS}$"), F.when(F.forall(octets, lambda x: x <= 255), "address"))
        .when(hit.rlike(rf"^(?:{SOCIAL})$"), "social")
        .when(hit.rlike(r"^[+(]|^\d{3}[-.]\d{3}[-.]\d{4}$|^\d{10}$"), F.when(F.length(digits).between(9, 15), "phone"))
        .when(F.length(digits).between(13, 19) & issuer & (_luhn(digits) == 0), "card")
    )


def _bare(form: Column) -> Column:
    return F.replace(form, F.lit(" "), F.lit(""))


def _mod97(account: Column) -> Column:
    """The remainder that is 1 for a valid account number: its first four characters go last, letters count from 10."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    place = F.transform(F.split(turned, r"(?!^)(?!\z)"), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(place, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10, the last digit counting once."""
    d = F.transform(F.split(F.reverse(digits), r"(?!^)(?!\z)"), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsDevanagari}"), "devanagari").when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _parts(hit: Column, kind: Column) -> Column:
    """(kind, value, form) of what is replaced in a hit: its words for a name (its title stays), else all of it.

    value is the same for all ways of writing an entity.
    """
    digits = F.regexp_replace(hit, r"\D", "")
    words = F.split(hit, " ")
    title = F.regexp_replace(words[0], r"\.", "")
    given = F.when(title.rlike(f"^(?:{MALE})$"), "male").when(title.rlike(f"^(?:{FEMALE})$"), "female").otherwise("given")
    part = lambda k, v, form: F.struct(k.alias("kind"), v.alias("value"), form.alias("form"))
    names = F.transform(words, lambda w, i: part(F.when(i == 0, "title").when((i == 1) & (F.size(words) > 2), given).otherwise("family"), F.when(i == 0, w).otherwise(F.lower(w)), w))
    value = F.when(kind.isin("email", "secret", "long_address"), F.lower(hit)).when(kind == "iban", _bare(hit)).when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "social"), digits).otherwise(hit)
    return F.when(kind == "name", names).otherwise(F.array(part(kind, value, hit)))


def _hash(secret: str, *cols: Column) -> Column:
    """256 hexadecimal digits that follow from the key and the columns."""
    text = F.concat_ws("\x1f", F.lit(secret), *cols)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}\x1f"), text), 256) for i in range(4)])


def _number(h: Column, at: Column, size: int) -> Column:
    return F.conv(F.substr(h, at, F.lit(6)), 16, 10).cast("int") % size


def _once(value: Column, f) -> Column:
    """f(value) with the value bound: what a lambda names is worked out for each element otherwise."""
    return F.transform(F.array(value), f)[0]


def _draw(secret: str) -> Column:
    """The surrogate of (kind, value) at attempt, in the form of value."""
    kind = F.col("kind")
    h = _hash(secret, F.when(kind.isin("male", "female", "given"), "given").otherwise(kind), F.col("value"), F.col("attempt").cast("string"))
    return _once(h, lambda h: _once(F.translate(h, "abcdef", "258369"), lambda decimal: _drawn(h, decimal)))


def _drawn(h: Column, decimal: Column) -> Column:
    """_draw's surrogate from the hexadecimal digits of its hash, and the decimal ones."""
    kind, value = F.col("kind"), F.col("value")
    n = F.length(value)
    swapped = lambda text, salt: F.array_join(
        F.transform(
            F.split(text, r"(?!^)(?!\z)"),
            lambda c, i: F.when(c.between("0", "9"), F.substr(decimal, i % 240 + salt, F.lit(1)))
            .when(c.between("a", "z"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(h, i % 240 + salt, 26) + 1, F.lit(1)))
            .when(c.between("A", "Z"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _number(h, i % 240 + salt, 26) + 1, F.lit(1)))
            .when(c.rlike(r"\p{IsCyrillic}"), F.substr(F.lit("абвгдежзиклмнопрстуфхцчшщэюя"), _number(h, i % 240 + salt, 28) + 1, F.lit(1)))
            .when(c.rlike(r"\p{IsDevanagari}"), F.substr(F.lit("कखगघचछजझटठडढणतथदधनपफबभमयरलवशसह"), _number(h, i % 240 + salt, 31) + 1, F.lit(1)))
            .when(c.rlike(r"\p{L}"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(h, i % 240 + salt, 26) + 1, F.lit(1)))
            .otherwise(c),
        ),
        "",
    )
    at = F.instr(value, "@")
    host = F.substr(value, at + 1)
    labels = F.split(host, r"\.")
    # All labels but the last two are swapped; then a reserved domain and the same top level.
    inner = F.array_join(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: swapped(x, 9)), ".")
    # A local part can be short: later attempts have one more label, of as many letters as it takes.
    grown = F.greatest(F.col("attempt") - (PLAIN - 1), F.lit(0))
    label = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.least(grown, F.lit(16)), F.lit(1))), lambda i: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(h, 120 + 6 * i, 26) + 1, F.lit(1))), "")
    label = F.when(grown > 0, F.concat(label, F.lit("."))).otherwise("")
    email = F.concat(swapped(F.substr(value, F.lit(1), at - 1), 1), F.lit("@"), label, F.when(F.length(inner) > 0, F.concat(inner, F.lit("."))).otherwise(""), F.lit("example."), F.element_at(labels, -1))
    first = F.when(value.rlike("^4"), F.substr(value, F.lit(1), F.lit(1))).otherwise(F.substr(value, F.lit(1), F.lit(2)))
    # Numbers get more digits; a card has 19 at most.
    more = F.least(grown, F.lit(16))
    body = F.concat(first, F.substr(decimal, F.lit(1), n - F.length(first) - 1 + F.greatest(F.least(more, 19 - n), F.lit(0))))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    phone = F.concat((2 + _number(h, F.lit(100), 8)).cast("string"), F.substr(decimal, F.lit(1), n - 1 + more))
    octet = lambda i: _number(h, F.lit(1 + 6 * i), 256).cast("string")
    # The small private range gives way to a larger one, and every range to the reserved one in the end.
    # More distinct addresses than the short form has are written in the long form's documentation range.
    group = lambda i: F.substr(h, F.lit(1 + 4 * i), F.lit(4))
    long_address = F.concat_ws(":", F.lit("2001:db8"), *[group(i) for i in range(6)])
    address = (
        F.when(grown > 8, long_address)
        .when(grown > 3, F.concat_ws(".", (240 + _number(h, F.lit(1), 15)).cast("string"), octet(1), octet(2), octet(3)))
        .when(value.startswith("192.168.") & (grown > 0), F.concat_ws(".", F.lit("172"), (16 + _number(h, F.lit(7), 16)).cast("string"), octet(2), octet(3)))
        .when(value.startswith("10."), F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3)))
        .when(value.startswith("192.168."), F.concat_ws(".", F.lit("192"), F.lit("168"), octet(2), octet(3)))
        .otherwise(F.concat_ws(".", (11 + _number(h, F.lit(1), 112)).cast("string"), octet(1), octet(2), octet(3)))
    )
    script = _script(value)
    issued = F.regexp_extract(value, rf"^{_ISSUED}", 0)
    token = F.concat(issued, swapped(F.substr(value, F.length(issued) + 1), 1))
    head, tail = F.regexp_extract(value, "^-----[^-]*-----", 0), F.regexp_extract(value, "-----[^-]*-----$", 0)
    block = F.concat(head, swapped(F.substr(value, F.length(head) + 1, n - F.length(head) - F.length(tail)), 1), tail)
    country, account = F.substr(value, F.lit(1), F.lit(2)), swapped(F.substr(value, F.lit(5)), 1)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)

    def name(script_: str) -> Column:
        syllables, ends = F.array(*[F.lit(x) for x in SYLLABLES[script_]]), F.array(*[F.lit(x) for x in ENDS[script_]])
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + F.least(F.col("attempt") / 8, F.lit(4)).cast("int")), lambda i: syllables[_number(h, 1 + 6 * i, len(SYLLABLES[script_]))]), "")
        end = F.when(kind == "male", 0).when(kind == "female", 1).when(kind == "given", 2).otherwise(3)
        return F.concat(stem, ends[end])

    names = F.when(script == "devanagari", name("devanagari")).when(script == "cyrillic", name("cyrillic")).otherwise(name("latin"))
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", F.substr(h, F.lit(1), n))
        .when(kind == "token", token)
        .when(kind == "block", block)
        .when(kind == "iban", iban)
        .when(kind == "address", address)
        .when(kind == "long_address", long_address)
        .when(kind == "phone", phone)
        .when(kind == "social", F.concat(F.lit("9"), F.substr(decimal, F.lit(1), n - 1 + more)))
        .when(kind == "card", card)
        .otherwise(names)
    )


#: Kinds whose surrogates must differ from each other.
_SPACE = "CASE WHEN kind IN ('male', 'female', 'given', 'family') THEN 'name' WHEN kind = 'long_address' THEN 'address' ELSE kind END"


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """entities (kind, value; distinct) with surrogate, no two of which are equal and none of which is a value.

    What collides is drawn again; after some attempts in the entity's own form the surrogates grow with the attempt,
    so there are more of them than entities.
    """
    drawn = shared.cut(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", _draw(secret)).withColumn("space", F.expr(_SPACE)), "drawn")
    for _ in range(ROUNDS):
        order = F.struct("attempt", "value", "kind")
        shared_by = drawn.groupBy("space", "surrogate").agg(F.min(order).alias("keeps"), F.count("*").alias("n")).where("n > 1").select("space", "surrogate", "keeps")
        real = drawn.select("space", F.col("value").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        marked = drawn.join(shared_by, ["space", "surrogate"], "left").join(real, ["space", "surrogate"], "left")
        again = F.coalesce("real", F.lit(False)) | (F.col("keeps").isNotNull() & (F.col("keeps") != order))
        marked = shared.cut(marked.select("kind", "value", "attempt", "surrogate", "space", again.alias("again")), "drawn")
        if not marked.where("again").limit(1).count():
            shared.forget(marked)
            return drawn.select("kind", "value", "surrogate")
        redrawn = marked.withColumn("attempt", F.col("attempt") + F.col("again").cast("int")).withColumn("new", _draw(secret))
        redrawn = redrawn.select("kind", "value", "attempt", F.when(F.col("again"), F.col("new")).otherwise(F.col("surrogate")).alias("surrogate"), "space")
        before, drawn = drawn, shared.cut(redrawn, "drawn")
        shared.forget(before, marked)
    raise RuntimeError("surrogates still collide after the last round")


def _written(kind: Column, form: Column, surrogate: Column) -> Column:
    """The surrogate in the form of the entity it stands for: its punctuation, country code and case."""
    digits = F.regexp_replace(form, r"\D", "")
    new = F.concat(F.substr(digits, F.lit(1), F.greatest(F.length(digits) - F.length(surrogate), F.lit(0))), surrogate)
    gaps = F.split(form, r"\d", -1)
    # A surrogate with more digits than the entity has the rest of them at its end.
    placed = F.concat(F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substr(new, i + 1, F.lit(1)))), ""), F.substr(new, F.size(gaps) + 1))
    upper = (form == F.upper(form)) & (form != F.lower(form))
    spaced = F.array_join(F.transform(F.split(form, r"(?!^)(?!\z)"), lambda c, i: F.when(c == " ", c).otherwise(F.substr(surrogate, i + 1 - F.length(F.regexp_replace(F.substr(form, F.lit(1), i), "[^ ]", "")), F.lit(1)))), "")
    titled = F.concat(F.upper(F.substr(surrogate, F.lit(1), F.lit(1))), F.substr(surrogate, F.lit(2)))
    return (
        F.when(kind.isin("phone", "card", "social"), placed)
        .when(kind.isin("male", "female", "given", "family"), F.when(upper & (F.length(form) > 1), F.upper(surrogate)).otherwise(titled))
        .when(upper & kind.isin("email", "secret", "long_address"), F.upper(surrogate))
        .when(kind == "iban", spaced)
        .otherwise(surrogate)
    )


def _fresh(name: str, columns: list[str]) -> str:
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def replace(docs: DataFrame, secret: str = "corpus-key", text: str = "text", counts: bool = False) -> DataFrame:
    """docs with the personal data in text replaced (and n_entities, if counts is set); its other columns as they were.

    secret is the key that surrogates follow from. A titled name's words are replaced wherever the text has them
    capitalised, title or not, unless the text has the same word in lower case as well. Rows keep their number; equal texts get equal results; null
    texts stay null and empty ones empty; tables without entities, or rows, come back as they are; very long texts
    are worked through whole, in time that follows their length; other columns can have any names (but those that begin
    with __pii_); where docs has a column n_entities, the new one has underscores added. Numbers that no
    card or account can have (issuer or check digits wrong) and addresses with parts above 255 are left alone.

    Texts meet the entities' table only if they hold entities: a filter of fixed size over their hashes is sent to
    all tasks, and the other texts are neither moved nor searched a second time.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    body = F.col(f"`{text}`")
    number = _fresh("n_entities", docs.columns)
    may = docs.where(_may(body)).select(F.md5(body).alias("key"), F.xxhash64(body).alias("h"), body.alias("body"), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)).alias("hits"))
    # The words of titled names that the text has in capitals only; a text with names is read again, for its capitalised words.
    titled = F.filter("hits", lambda x: x.rlike(rf"^(?:{MALE}|{FEMALE}|{NEUTRAL})[. ]"))
    known = F.array_distinct(F.flatten(F.transform(titled, lambda x: F.slice(F.split(F.lower(x), " "), 2, 3))))
    known = F.when(F.size("hits") > 0, known).otherwise(F.array().cast("array<string>"))
    may = may.where(F.size("hits") > 0).withColumn("known", known)
    named = F.size("known") > 0
    bare = F.when(named, F.array_except("known", F.regexp_extract_all("body", F.lit(_SMALL), F.lit(0)))).otherwise(F.col("known"))
    may = may.select("key", "h", bare.alias("known"), F.when(named, F.regexp_extract_all("body", F.lit(WIDE), F.lit(0))).otherwise(F.col("hits")).alias("hits"), named.alias("wide"))
    hits = may.groupBy("key").agg(*[F.first(c).alias(c) for c in ("hits", "h", "known", "wide")])
    hits = shared.cut(hits, "pii-hits")
    parts = hits.select("key", "h", "wide", F.posexplode("hits").alias("i", "hit")).withColumn("kind", _kind(F.col("hit")))
    left = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lower("hit").alias("value"), F.col("hit").alias("form")))
    parts = parts.select("key", "h", "wide", "i", F.when(F.col("kind").isNotNull(), _parts(F.col("hit"), F.col("kind"))).otherwise(left).alias("parts"))
    parts = shared.cut(parts.select("key", "h", "wide", "i", F.posexplode("parts").alias("j", "part")).select("key", "h", "wide", "i", "j", "part.*"), "pii")
    # A bare word takes the kind that it has in a titled name of its text; that of family names first.
    allowed = hits.select("key", F.explode("known").alias("value"))
    words = parts.where(F.col("kind").isin("family", "female", "male", "given")).groupBy("key", "value").agg(F.min("kind").alias("as_name")).join(allowed, ["key", "value"])
    met = parts.where(F.col("kind").isNull() & F.col("wide")).drop("kind").join(words.withColumnRenamed("as_name", "kind"), ["key", "value"], "left")
    parts = shared.cut(parts.where(F.col("kind").isNotNull() | ~F.col("wide")).unionByName(met), "pii-met")
    live = F.col("kind").isNotNull() & (F.col("kind") != "title")
    # One text can have very many entities: drawing them is dealt to all tasks.
    entities = parts.where(live).select("kind", "value").distinct().repartition(docs.sparkSession.sparkContext.defaultParallelism, "kind", "value")
    table = surrogates(entities, secret)
    joined = parts.join(table, ["kind", "value"], "left")
    new = F.when(F.col("surrogate").isNull(), F.col("form")).otherwise(_written(F.col("kind"), F.col("form"), F.col("surrogate")))
    pieces = joined.select("key", "h", "wide", "i", "j", new.alias("new"), F.col("kind").isNotNull().alias("found"))
    # First the parts of each hit, then the hits of each text: each list is sorted once.
    whole = F.array_join(F.sort_array(F.collect_list(F.struct("j", "new")))["new"], " ")
    each = pieces.groupBy("key", "i").agg(whole.alias("new"), F.max("found").alias("found"), F.first("h").alias("h"), F.first("wide").alias("wide"))
    listed = F.sort_array(F.collect_list(F.struct("i", "new")))["new"]
    news = each.groupBy("key").agg(listed.alias("__pii_news"), F.count_if("found").cast("int").alias("__pii_found"), F.first("h").alias("h"), F.first("wide").alias("__pii_wide"))
    news = shared.cut(news.withColumnRenamed("key", "__pii_key").where("__pii_found > 0"), "pii-news")
    shared.forget(parts, hits)
    n = news.count()
    if not n:
        return docs.withColumn(number, F.lit(0)) if counts else docs
    marked, holds = shared.filtered(docs.select(*columns, F.xxhash64(body).alias("__pii_h")), "__pii_h", news.select("h"), n)
    rest = marked.where(~holds).select(*columns, F.lit(0).alias("__pii_found"))
    placed = marked.where(holds).select(*columns, F.md5(body).alias("__pii_key")).join(news.drop("h"), "__pii_key", "left")
    gaps = F.when(F.col("__pii_wide"), F.split(body, WIDE, -1)).otherwise(F.split(body, PATTERN, -1))
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, F.col("__pii_news"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = placed.select(*[F.when(F.col("__pii_news").isNull(), body).otherwise(rebuilt).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns], F.coalesce("__pii_found", F.lit(0)).alias("__pii_found"))
    out = out.unionByName(rest)
    return out.withColumnRenamed("__pii_found", number) if counts else out.drop("__pii_found")
