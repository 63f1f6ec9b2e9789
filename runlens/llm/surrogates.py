"""Surrogates for personal data and secrets (operator 4), with DataFrame and SQL functions only.

Entities are found by one pattern, brought to a canonical form (so that spellings of one entity corefer), and get a
surrogate that a key and the canonical form determine: same type, same shape, same script, names of the same gender.
The table of distinct entities is then checked: a surrogate that two entities share, or that is itself an entity of
the corpus, is drawn again until all are distinct.  A format may have fewer surrogates than the corpus has entities of
it ("3@5.99", "+12345"), so later draws take a wider form: letters at the end of an e-mail's local part, digits at the
end of a number, one more octet, letters or hexadecimal digits at the end of a secret.  Texts are put together again from the pieces between the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import materialize

#: Draws per entity in its own format; later ones take a wider form, by one more sign each time.
PLAIN_DRAWS = 4

# Titles by gender, and syllables of invented family names, given names and lower-case letters by script.
_TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"],
    "n": ["Dr", "Prof"],
}
_GIVEN = {
    "latin": {"f": ["Anna", "Clara", "Elena", "Ida", "Julia", "Lena", "Marta", "Nora"], "m": ["Adam", "Bruno", "Emil", "Hugo", "Jonas", "Leo", "Oskar", "Viktor"], "n": ["Alex", "Kim", "Robin", "Sascha"]},
    "cyrillic": {"f": ["Анна", "Вера", "Ирина", "Ольга"], "m": ["Антон", "Борис", "Игорь", "Павел"], "n": ["Саша", "Женя"]},
    "greek": {"f": ["Άννα", "Ελένη", "Μαρία", "Σοφία"], "m": ["Γιάννης", "Κώστας", "Νίκος", "Πέτρος"], "n": ["Αλεξ"]},
}
_SYLLABLES = {
    "latin": ["ba", "den", "fel", "gor", "hal", "ker", "lin", "mar", "nov", "ris", "sol", "tan", "ul", "ver", "win", "zan"],
    "cyrillic": ["бе", "вал", "гор", "дар", "зим", "кал", "лев", "мир", "нов", "рос", "сол", "тал", "ур", "фед", "хар", "чер"],
    "greek": ["βα", "γορ", "δημ", "ζαν", "καλ", "λαμ", "μαρ", "νικ", "παπ", "ρηγ", "σολ", "ταν", "φιλ", "χαρ", "ψαλ", "ωρ"],
}
_LETTERS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "accented": "àáâäçèéêëìíîïñòóôöùúûü"}
_CLASSES = {"cyrillic": r"[Ѐ-ӿ]", "greek": r"[Ͱ-Ͽ]", "accented": r"[À-ɏ]"}

_TITLE = "|".join(t for titles in _TITLES.values() for t in titles)
_APOSTROPHE = r"['’](?!s(?!\p{L}))"  # a possessive s is no part of the name
# every loop is possessive or over one character class: others recurse in the regex engine, once per round
_WORD = rf"[\p{{L}}\p{{M}}]*+(?:(?:-|{_APOSTROPHE})(?=\p{{L}})[\p{{L}}\p{{M}}]++){{0,6}}+"  # up to six hyphens or apostrophes
_NAME = rf"(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}(?=[\p{{L}}\p{{M}}]|(?:-|{_APOSTROPHE})\p{{L}}){_WORD}"
_INITIAL = r"(?:(?:\p{Lu}\.-?){1,4}+|\p{Lu}(?![\p{L}\p{M}.'’-]))"
_PARTICLE = "(?:von|van|der|den|del|della|de|di|da|du|la|le|zu|bin|al)"
# white space with one line break at most; after a break, words that begin sentences are no names
_SPACE = r"[\s\p{Z}]"
_BLANK = r"[\s\p{Z}&&[^\n]]"
_GAP = rf"(?:{_BLANK}++|{_BLANK}*+\n{_BLANK}*+(?!(?:The|He|She|It|They|We|You|In|On|At|This|That|Der|Die|Das|Er|Sie|Es)(?!\p{{L}})))"
#: A titled name has up to so many titles, name words, and initials or particles before each of these.
_TITLES_MOST, _WORDS_MOST, _SMALL_MOST = 6, 10, 6
_FULL = rf"(?:(?:{_INITIAL}|{_PARTICLE}){_GAP}){{0,{_SMALL_MOST}}}+{_NAME}"
#: Types in the order in which the pattern tries them.  Digits next to a match are never cut off.  Long runs are entered
#: at their start alone and looked through once, so that the time of a text is linear in its length.
_PATTERNS = {
    "email": r"(?<![\p{L}\p{N}]|[\p{L}\p{N}][._%+-]{1,8})[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,999}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+(?<=\.(?:\p{L}{2,63}|xn--[a-z0-9-]{1,59}))",
    "secret": r"\b(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}+\b|\b(?:sk|pk|ghp|AKIA)[_-]?(?=[\w-]{0,400}\d)[A-Za-z0-9_-]{15,}[A-Za-z0-9_]\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{4}(?!\d)|(?<!\d)3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?(?:{_GAP}(?:{_TITLE})\.?(?!\p{{L}})){{0,{_TITLES_MOST}}}+{_GAP}{_FULL}(?:{_GAP}{_FULL}){{0,{_WORDS_MOST}}}+",
}
PATTERN = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: What every match holds; most texts hold none of it, and only this is looked for in them.
_HINT = rf"[0-9@]|(?:{_TITLE})\.?{_SPACE}"


def _type_of(raw: Column) -> Column:
    """The first type whose pattern is the whole match, with a mark where it stands alone."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(_PATTERNS.items()):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _canonical(kind: Column, raw: Column) -> Column:
    """Spellings of one entity in one form: case, separators and a leading country code 1 aside."""
    digits = _digits(raw)
    phone = F.when(digits.rlike("^1[0-9]{10}$"), F.substring(digits, 2, 10)).otherwise(digits)
    return (
        F.when(kind.isin("email", "name") | ((kind == "secret") & raw.rlike("^[0-9a-fA-F]+$")), F.lower(raw))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", phone)
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .otherwise(raw)
    )


def _script(x: Column) -> Column:
    return F.when(x.rlike(_CLASSES["cyrillic"]), F.lit("cyrillic")).when(x.rlike(_CLASSES["greek"]), F.lit("greek")).otherwise(F.lit("latin"))


def _draw(seed: Column, i: Column) -> Column:
    """The i-th number (0 to 65535) of the stream that the seed determines."""
    block = F.sha2(F.concat_ws("|", seed, F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substr(block, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?s)."), 0)


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _shaped(x: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Each letter and digit replaced by another of its kind; everything else stays."""

    def one(c: Column, i: Column) -> Column:
        n = _draw(seed, i)
        small = F.lower(c)
        letter = _pick("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz", n)
        for name, kind in _CLASSES.items():
            letter = F.when(small.rlike(kind), _pick(_LETTERS[name], n)).otherwise(letter)
        letter = F.when(c == small, letter).otherwise(F.upper(letter))
        return F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(_chars(x), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum when the rightmost digit is doubled first."""
    doubled = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def _card(digits: Column, seed: Column, more: Column) -> Column:
    """Another card number; one that passes the Luhn check gets one that passes, others one that may fail."""
    fresh = F.concat(F.substring(digits, 1, 1), F.substr(_shaped(digits, seed), F.lit(2)), more)
    body = F.substr(fresh, F.lit(1), F.length(fresh) - 1)
    check = ((F.lit(10) - _luhn_sum(body) % 10) % 10).cast("string")
    valid = (_luhn_sum(F.substr(digits, F.lit(1), F.length(digits) - 1)) + F.substr(digits, F.length(digits), F.lit(1)).cast("int")) % 10 == 0
    return F.when(valid, F.concat(body, check)).otherwise(fresh)


#: What tells a secret's type.
_PREFIX = "^(?:sk|pk|ghp|AKIA)[_-]?"


def _mod97(x: Column) -> Column:
    """Remainder of the number that the letters (A is 10) and digits spell."""
    return F.aggregate(_chars(x), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + c.try_cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97)


def _iban(canon: Column, seed: Column, more: Column) -> Column:
    """Another account of the country; one with right check digits gets right ones."""
    country, account = F.substring(canon, 1, 2), F.concat(F.substr(_shaped(canon, seed), F.lit(5)), more)
    valid = _mod97(F.concat(F.substr(canon, F.lit(5)), F.substring(canon, 1, 4))) == 1
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(valid, check).otherwise(F.substring(_shaped(canon, seed), 3, 2)), account)


def _seed(kind: Column, canon: Column, key: str, draw: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, draw.cast("string")), 256)


def _surrogate(kind: Column, canon: Column, gender: Column, seed: Column, draw: Column) -> Column:
    """The canonical surrogate of a canonical entity at its ``draw``-th try; ``seed`` is a column, hashed once per entity."""
    n = lambda i: _draw(seed, F.lit(i))
    # the signs of a wider form; none in the first draws
    wider = F.greatest(draw - F.lit(PLAIN_DRAWS - 1), F.lit(0))
    more = lambda sign, **kw: _shaped(F.repeat(F.lit(sign), wider), F.sha2(F.concat(seed, F.lit("+")), 256), **kw)
    digits = more("0")
    at = F.instr(canon, "@")
    email = F.concat(_shaped(F.substr(canon, F.lit(1), at - 1), seed), more("a"), F.lit("@"), _shaped(F.substring_index(F.substr(canon, at + 1), ".", 1), F.sha2(seed, 256)), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), n(3) % 3 + 1))
    octet = lambda i: (n(i) % 254 + 1).cast("string")
    ip = F.concat_ws(".", *(octet(i) for i in range(4)), F.transform(F.filter(F.sequence(F.lit(0), wider), lambda i: i > 0), lambda i: (_draw(seed, i + 3) % 254 + 1).cast("string")))
    own = F.substring_index(canon, " ", 1)
    script = _script(F.when(kind == "given", own).otherwise(canon))
    size = F.when(kind == "given", wider).otherwise(draw + 2)
    family, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, syllables in _SYLLABLES.items():
        # later draws take more syllables, so that names never run out
        made = F.array_join(F.transform(F.sequence(F.lit(0), size), lambda i: F.element_at(F.array(*map(F.lit, syllables)), _draw(seed, i + 8) % len(syllables) + 1)), "")
        family = F.when(script == name, made).otherwise(family)
        by = [F.when(gender == g, F.element_at(F.array(*map(F.lit, names)), n(5) % len(names) + 1)) for g, names in _GIVEN[name].items()]
        given = F.when(script == name, F.when(wider > 0, made).otherwise(F.lower(F.coalesce(*by)))).otherwise(given)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", _card(canon, seed, digits))
        .when(kind == "secret", F.when(canon.rlike("^[0-9a-f]+$"), F.concat(_shaped(canon, seed, hexadecimal=True), more("a", hexadecimal=True))).otherwise(F.concat(F.regexp_extract(canon, _PREFIX, 0), _shaped(F.regexp_replace(canon, _PREFIX, ""), seed), more("a"))))
        .when(kind == "family", family)
        .when(kind == "given", given)
        .when(kind == "initial", F.concat(_shaped(own, seed), more("a")))
        .when(kind == "iban", _iban(canon, seed, digits))
        .otherwise(F.concat(_shaped(canon, seed), digits))
    )


def _spelt(kind: Column, raw: Column, canon: Column, new: Column) -> Column:
    """The canonical surrogate in the spelling of the match: its separators, its case.  A wider form's digits follow."""
    total = F.length(_digits(raw))
    more = F.substr(new, F.length(canon) + 1)
    chars = _chars(raw)

    def digit(c: Column, i: Column) -> Column:
        seen = F.length(_digits(F.array_join(F.slice(chars, 1, i + 1), "")))
        own = seen - (total - F.length(canon))
        return F.when(c.rlike("[0-9]") & (own > 0), F.substr(new, own, F.lit(1))).otherwise(c)

    def sign(c: Column, i: Column) -> Column:
        seen = F.length(F.regexp_replace(F.array_join(F.slice(chars, 1, i + 1), ""), " ", ""))
        return F.when(c == " ", c).otherwise(F.substr(new, seen, F.lit(1)))

    cased = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(new)).otherwise(new)
    # O'Brien, McDonald: an apostrophe behind the first letter and capitals inside stay where they are
    apart = raw.rlike("^\\p{L}['’]")
    bare = F.regexp_replace(raw, "['’]", "")
    capital = lambda c, i: F.when((i == 0) | F.substr(bare, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)
    named = F.array_join(F.transform(_chars(new), capital), "")
    named = F.when(apart, F.concat(F.substring(named, 1, 1), F.substring(raw, 2, 1), F.initcap(F.substr(named, F.lit(2))))).otherwise(named)
    return (
        F.when(kind.isin("card", "ssn", "phone"), F.concat(F.array_join(F.transform(chars, digit), ""), more))
        .when(kind == "iban", F.concat(F.array_join(F.transform(chars, sign), ""), more))
        .when(kind.isin("family", "given"), F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(named)).otherwise(named))
        .when(kind == "initial", F.when(raw.contains("."), F.regexp_replace(F.upper(new), r"(\p{L})", "$1.")).otherwise(F.upper(new)))
        .when(kind.isin("email", "secret"), cased)
        .otherwise(new)
    )


#: Between a text's pieces and matches; a text's own first sign is told apart by the third.  None is a letter or digit.
_MARK, _CUT, _OWN = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"


def marked(text: Column) -> Column:
    """The text with its matches between marks, by the one pass of the pattern."""
    safe = F.when(text.contains(_MARK), F.replace(text, F.lit(_MARK), F.lit(_OWN))).otherwise(text)
    return F.when(text.rlike(_HINT), F.regexp_replace(safe, f"({PATTERN})", f"{_CUT}$1{_CUT}")).otherwise(safe)


def _pieces(text: Column, matches: bool) -> Column:
    """Of a marked text the matches, or the pieces around them."""
    return F.transform(
        F.filter(F.split(text, _CUT, -1), lambda _, i: i % 2 == (1 if matches else 0)), lambda p: F.replace(p, F.lit(_OWN), F.lit(_MARK))
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, row, pos, part, kind, raw, sep, canon, gender) of rows (doc, row, marked): every match, names by their words
    and the hyphenated parts of these; titles have no kind."""
    found = docs.select("doc", "row", F.posexplode(_pieces(F.col("marked"), True)).alias("pos", "raw"))
    found = found.withColumn("kind", F.coalesce(_type_of(F.col("raw")), F.lit("phone")))
    name = F.col("kind") == "name"
    words = F.when(name, F.regexp_extract_all("raw", F.lit(rf"(?:{_SPACE}++|-)?[^\s\p{{Z}}-]++-?+(?![^\s\p{{Z}}])|(?:{_SPACE}++|-)?[^\s\p{{Z}}-]++"), 0)).otherwise(F.array("raw"))
    bare = lambda word: F.regexp_replace(word, rf"^(?:{_SPACE}+|-)", "")
    last_word = F.regexp_extract("raw", r"[^\s\p{Z}]+$", 0)
    # the hyphenated parts of the last word are all the family name's
    own_from = F.size(words) - F.size(F.split(last_word, "-"))
    gender = F.lit("n")
    for g in ("m", "f"):
        gender = F.when(F.col("raw").rlike(rf"^(?:(?:{_TITLE})\.?{_SPACE}+)*(?:{'|'.join(_TITLES[g])})\.?{_SPACE}"), F.lit(g)).otherwise(gender)
    found = found.select("doc", "row", "pos", "kind", F.posexplode(words).alias("part", "word"), own_from.alias("own_from"), F.lower(last_word).alias("family"), gender.alias("gender"))
    found = found.withColumn("raw", bare(F.col("word"))).withColumn("sep", F.when(name, F.regexp_extract("word", rf"^(?:{_SPACE}+|-)", 0)).otherwise(F.lit("")))
    found = found.withColumn("raw", F.when(name, F.col("raw")).otherwise(F.col("word")))
    last = F.col("part") >= F.col("own_from")
    kept = (F.col("part") == 0) | F.col("raw").rlike(rf"^(?:(?:{_TITLE})\.?|{_PARTICLE})$")
    kind = F.when(~name, F.col("kind")).when(last, F.lit("family")).when(kept, F.lit("title")).when(F.col("raw").rlike(rf"^{_INITIAL}$"), F.lit("initial")).otherwise(F.lit("given"))
    # a given name is that of a person: the family name belongs to it
    canon = (
        F.when(F.col("kind") == "family", F.lower("raw"))
        .when(F.col("kind") == "given", F.concat_ws(" ", F.lower("raw"), "family"))
        .when(F.col("kind") == "initial", F.concat_ws(" ", F.regexp_replace(F.lower("raw"), "[.-]", ""), "family"))
        .otherwise(_canonical(F.col("kind"), F.col("raw")))
    )
    return found.withColumn("kind", kind).select(
        "doc", "row", "pos", "part", "kind", "raw", "sep", canon.alias("canon"), F.when(F.col("kind") == "given", F.col("gender")).otherwise(F.lit("n")).alias("gender")
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, gender, new) of distinct (kind, canon, gender): no two entities of a kind share a surrogate, and
    no surrogate is an entity.  Given names and initials, which are few, are distinct within a family name and never
    their own surrogate, so no two people become one.
    """
    entities = materialize(entities.select("kind", "canon", "gender").distinct(), "entities")
    person = F.col("kind").isin("given", "initial")
    real = entities.where(~person).select("kind", F.lit("").alias("scope"), F.col("canon").alias("new")).distinct()
    scope = F.when(person, F.regexp_replace("canon", "^[^ ]* ", "")).otherwise(F.lit(""))
    open_ = entities.withColumn("draw", F.lit(0))
    settled = entities.limit(0).select("kind", "canon", "gender", F.lit("").alias("scope"), F.lit("").alias("new"))
    while not open_.isEmpty():  # wider forms never run out
        drawn = materialize(open_.withColumn("scope", scope).withColumn("seed", _seed(F.col("kind"), F.col("canon"), key, F.col("draw"))).withColumn("new", _surrogate(F.col("kind"), F.col("canon"), F.col("gender"), F.col("seed"), F.col("draw"))).drop("seed"), "drawn")
        # the smallest of those that drew the same keeps it, unless it is taken or real
        other = ~person | (F.col("new") != F.substring_index("canon", " ", 1))
        first = drawn.where(other).groupBy("kind", "scope", "new").agg(F.min(F.struct("canon", "gender")).alias("who")).select("kind", "scope", "new", "who.*")
        free = first.join(real, ["kind", "scope", "new"], "left_anti").join(settled.select("kind", "scope", "new"), ["kind", "scope", "new"], "left_anti")
        won = materialize(drawn.join(free, ["kind", "canon", "gender", "new"], "left_semi").select("kind", "canon", "gender", "scope", "new"), "won")
        settled = settled.unionByName(won)
        open_ = materialize(drawn.join(won, ["kind", "canon", "gender"], "left_anti").select("kind", "canon", "gender", (F.col("draw") + 1).alias("draw")), "open")
    return settled.drop("scope")


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, entity_kinds), one row per row of ``docs`` (doc_id, text).

    Every e-mail address, phone, card, social security, IP and IBAN number, secret and titled name is replaced by its
    surrogate, everywhere the same for one entity (coreference) and different for different ones.  Other mentions of a
    document's titled family names, capitalised, follow them where a possessive or an initial marks them, or inside a
    sentence unless another capitalised word comes next; they are not in n_entities.  Texts without entities, empty texts and nulls come back unchanged, with 0 entities.  Repeated rows all come back; a null doc_id
    is allowed; other columns are ignored; an empty table gives an empty result.  ``key`` is the secret of the draw.
    """
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("row"), marked(F.col("text")).alias("marked"))
    keyed = materialize(keyed, "marked")  # the pattern runs here, once per text
    holds = F.coalesce(F.col("marked").contains(_CUT), F.lit(False))
    private, clean = keyed.where(holds), keyed.where(~holds)
    found = materialize(occurrences(private).distinct(), "found")
    table = surrogate_table(found.where("kind <> 'title'"), key)
    parts = found.join(table, ["kind", "canon", "gender"], "left").select(
        "doc", "row", "pos", "part", "kind", F.concat("sep", F.when(F.col("kind") == "title", F.col("raw")).otherwise(_spelt(F.col("kind"), F.col("raw"), F.col("canon"), F.col("new")))).alias("new"),
        F.when(F.col("kind") == "family", F.struct("canon", F.col("new").alias("to"))).alias("mention"),
    )
    # a document's own matches, in their order
    lists = parts.groupBy(F.coalesce("doc", F.lit(0)).alias("d"), F.col("doc").isNull().alias("none"), F.col("row").alias("r")).agg(F.sort_array(F.collect_list(F.struct("pos", "part", "kind", "new"))).alias("parts"), F.map_from_entries(F.collect_set("mention")).alias("names"))
    same = F.coalesce(F.col("doc"), F.lit(0)).eqNullSafe(F.col("d")) & (F.col("doc").isNull() == F.col("none")) & (F.col("row") == F.col("r"))
    # other mentions of the document's own family names, as capitalised words that a context supports
    def swapped(piece: Column) -> Column:
        tokens = F.regexp_extract_all(piece, F.lit(rf"\p{{L}}{_WORD}|[^\p{{L}}]++"), 0)

        def put(ts: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                at = lambda k: F.coalesce(F.get(ts, i + k), F.lit(""))
                possessive = at(1).rlike("^['’]$") & (at(2) == "s")
                initial = at(-1).rlike(r"^\.[ -]?$") & at(-2).rlike(r"^\p{Lu}$")
                inside = (i > 0) & at(-1).rlike(r"^[\s\p{Z}&&[^\n]]*,?[\s\p{Z}&&[^\n]]+$")  # no sentence starts with it
                longer = at(1).rlike(r"^[\s\p{Z}-]+$") & at(2).rlike(r"^\p{Lu}")  # "The White House"
                to = F.try_element_at("names", F.lower(w))
                supported = possessive | initial | (inside & ~longer)
                return F.when(w.rlike(r"^\p{Lu}") & to.isNotNull() & supported, _spelt(F.lit("family"), w, w, to)).otherwise(w)

            return F.array_join(F.transform(ts, one), "")

        return F.element_at(F.transform(F.array(tokens), put), 1)

    cut = _pieces(F.col("marked"), False)
    joined = private.join(lists, same).withColumn("pieces", F.when(F.size("names") > 0, F.transform(cut, swapped)).otherwise(cut))
    pieces = F.col("pieces")
    # the parts of one match follow each other, and each match stands after its piece
    put = F.transform("parts", lambda p: F.concat(F.when(p["part"] == 0, F.element_at(pieces, p["pos"] + 1)).otherwise(F.lit("")), p["new"]))
    text = F.concat(F.array_join(put, ""), F.element_at(pieces, -1))
    starts = F.filter("parts", lambda p: p["part"] == 0)
    replaced = joined.select(
        F.col("doc").alias("doc_id"), text.alias("text"), F.size(starts).cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(F.transform(starts, lambda p: F.when(p["kind"] == "title", F.lit("name")).otherwise(p["kind"])))).alias("entity_kinds"),
    )
    untouched = clean.select(F.col("doc").alias("doc_id"), F.replace("marked", F.lit(_OWN), F.lit(_MARK)).alias("text"), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("entity_kinds"))
    return replaced.unionByName(untouched)
