"""Surrogates for personal data: each detected entity is replaced by a keyed one of the same type and form."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Shelter, materialise, table

#: Honorifics by the gender that they tell: m, f or none (n).
HONORIFICS = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Madam", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
SECRET_NAMES = "password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key"
#: Small words within a person's name, which stay.
PARTICLES = "van|von|vom|zu|zum|zur|der|den|de|del|della|di|da|do|dos|du|la|le|las|los|ten|ter|y|bin|ibn|al|el"
_TITLES = "|".join(t for g in HONORIFICS.values() for t in g)
#: A part of a name (McDonald, O'Brien, Anne-Marie, SMITH), an initial, and names of any number of parts.
_NAME = r"\p{Lu}(?:\p{L}++(?:[-'’]\p{Lu}\p{L}*+)*+|(?:[-'’]\p{Lu}\p{L}++)++)"
_INITIALS = r"(?:\p{Lu}\. ?)"
_NAMES = rf"(?:{_INITIALS}++(?=\p{{Lu}}))?{_NAME}(?: (?:(?:{PARTICLES}) ){{0,3}}+(?:{_INITIALS}++(?=\p{{Lu}}\p{{L}}))?{_NAME})*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_US = r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
#: Four groups of four count as a card at once, other lengths and forms by Luhn's check.
_CARD = r"\d{4}(?:\d{12}|(?: \d{4}){3}|(?:-\d{4}){3})"
#: Country calling codes: one digit, the two-digit ones, else three.
_CALLING = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Phones as they are dialled at home (0 30 ..., 01 42 ...) and abroad (00 and a country): 9 to 13 and 10 to 15 digits.
_HOME = r"(?<![\d.,:/-])(?:(?=0(?:[ /-]?\d){8,12}(?![ /-]?\d))0[1-9]\d{0,4}[ /-]\d{2,8}(?: \d{2,4}){0,4}(?![\w:])|(?=00(?:[ -]?\d){8,13}(?![ -]?\d))00[1-9]\d*(?: \d+){0,6}(?![\w:]))"
#: In the order in which they are tried at each place. Java's regular expressions.
PATTERNS = {
    "secret": rf"""(?<![A-Za-z0-9])(?i:{SECRET_NAMES})["']?\s{{0,3}}(?:=>|[=:])\s{{0,3}}(?:"(?=[^"\n]*?[A-Za-z0-9])[^"\n]{{6,}}+(?="|\z)|'(?=[^'\n]*?[A-Za-z0-9])[^'\n]{{6,}}+(?='|\z)|["']?(?=[^\s"<A-Za-z0-9]*+[A-Za-z0-9])(?:[^\s"<]{{8,}}+|(?=[^\s"<\d]*+\d)[^\s"<]{{6,}}+))""",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,127}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![A-Za-z0-9])",
    "low_iban": r"(?<![A-Za-z0-9])[a-z]{2}\d{2}[a-z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": rf"(?<!\d)(?:{_CARD}(?!\d)|\d(?:[ -]?\d){{12,18}}(?![ -]?\d))",
    "phone": rf"(?<![\w+])(?:(?:\+\d{{1,3}}[ .-]?)?{_US}(?!\d)|\+(?:[ .-]?\(?\d\)?){{8,15}}(?!\d)|(?<![\d.-])\d{{10}}(?!\w)|{_HOME})",
    "ip6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "person": rf"(?<![\p{{L}}\d])(?:{_TITLES})\.? {_NAMES}(?![\p{{L}}\d])",
    # two names right before an e-mail address that is made of them
    "signed": rf"(?<![\p{{L}}\d])(?<gn>{_NAME}) (?<fn>{_NAME})(?=[ ,;:]{{0,3}}(?i:e?-?mail:? ?)?[<(\[]?(?iu:\k<gn>[._-]?\k<fn>)@)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Rounds in which colliding surrogates are drawn again; one that is longer every second time, where its type allows that.
ROUNDS = 60
_SYLLABLES = {"latin": "ba be bi bo da de di do la le li lo ma me ra ro".split(), "cyrillic": "ба бе би бо да де ди до ла ле ли ло ма ме ра ро".split(), "greek": "βα βε βι βο δα δε δι δο λα λε λι λο μα με ρα ρο".split()}
#: Endings of given names of men, women and of no gender told, and of family names.
_ENDS = {"latin": ("n", "na", "", "s"), "cyrillic": ("н", "на", "", "в"), "greek": ("ν", "να", "", "ς")}
#: An attempt is a draw times four and how a given name ends: as its own ending suggests, or as its titles tell (man, woman, both).
_DRAW, _MAN, _WOMAN, _BOTH = 4, 1, 2, 3
#: What parts a text where an entity starts and ends, and what stands for it and for its escape where a text holds them.
_MARK, _ESCAPE, _MARK_IN, _ESCAPE_IN = "\x00", "\x01", "\x01\x02", "\x01\x03"


def _kind(m: Column) -> Column:
    """The type of a match; `none` for a number that is no card and a word that is no IBAN. The patterns are tried as in a text, but for what must stand around."""
    out = None
    for k in ("secret", "person", "email", "ssn", "ip", "ip6", "iban", "phone"):
        hit = m.rlike(rf"\A(?:{PATTERNS[k]})\z".replace(r"(?<![A-Za-z0-9])", "").replace(r"(?<![\p{L}\d])", ""))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    out = out.when(m.rlike(r"\A\p{Lu}"), "person")  # signed
    low = F.upper(m)
    out = out.when(m.rlike(r"\A[a-z]"), F.when(_iban(F.substring(low, 1, 2), F.substring(low, F.lit(5), F.length(low))) == low, "iban").otherwise("none"))
    digits = F.regexp_replace(m, r"\D", "")
    n = F.length(digits)
    valid = m.rlike(rf"\A{_CARD}\z") | (_luhn(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1)))
    return out.when(valid, "card").otherwise("none")


def _prefix(kind: Column, m: Column) -> Column:
    """What of a match stays as it is: the name of a secret, the title of a person, the country code of a number."""
    return F.when(kind == "secret", F.regexp_extract(m, r"\A[^=:]*(?:=>|[=:])\s*[\"']?", 0)).when(kind == "person", F.regexp_extract(m, rf"\A(?:{_TITLES})\.? ", 0)).when(kind == "phone", F.regexp_extract(m, rf"\A(?:\+\d{{1,3}}[ .-]?(?={_US}\z)|\+{_CALLING}[ .-]?|00{_CALLING} ?|0[1-9](?=[\d /-]))", 0)).otherwise("")


def _script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _tokens(body: Column) -> Column:
    """The parts of a person's names: a blank after an initial may be missing."""
    return F.split(F.regexp_replace(body, r"\.(?=[^ ])", ". "), " ")


def _is_entity(token: Column) -> Column:
    """Whether a part of a name is one that has a surrogate; initials are drawn, particles stay."""
    return ~token.rlike(rf"\A(?:\p{{Lu}}\.|{PARTICLES})\z")


def _proper(token: Column) -> Column:
    """A name's canonical form: of one in capitals, with one capital."""
    return F.when((F.length(token) > 1) & (token == F.upper(token)), F.initcap(F.lower(token))).otherwise(token)


def entities(m: Column, kind: Column | None = None) -> Column:
    """The entities of a match as structs of type, canonical form, gender (m, f or empty) and form in the text. A person has one for each
    part of the name, so that any may come back alone; the last is the family's. The title is no part of a name: Dr. and Mr. John are one John."""
    kind = _kind(m) if kind is None else kind
    body = F.substring(m, F.length(_prefix(kind, m)) + 1, F.length(m))
    title = F.regexp_extract(m, rf"\A({_TITLES})\.? ", 1)
    gender = F.when(title.isin(*HONORIFICS["m"]), "m").when(title.isin(*HONORIFICS["f"]), "f").otherwise("")
    entity = lambda t, c, g, raw: F.struct(t.alias("type"), c.alias("canon"), g.alias("gender"), raw.alias("raw"))
    names = F.filter(_tokens(body), _is_entity)
    persons = F.transform(names, lambda x, i: entity(F.when(i == F.size(names) - 1, "family").otherwise("given"), _proper(x), F.when((i == 0) & (F.size(names) > 1), gender).otherwise(""), x))
    canon = F.when(kind.isin("email", "ip6"), F.lower(body)).when(kind.isin("card", "phone", "ssn"), F.regexp_replace(body, r"\D", "")).when(kind == "iban", F.upper(F.replace(body, F.lit(" "), F.lit("")))).otherwise(body)
    none = F.expr("cast(array() as array<struct<type: string, canon: string, gender: string, raw: string>>)")
    return F.when(kind == "none", none).when(kind == "person", persons).otherwise(F.array(entity(kind, canon, F.lit(""), body)))


def _suggests_woman(name: Column) -> Column:
    return name.rlike("[aаяαη]$")


def _stream(key: str, type_: Column, canon: Column, attempt: Column) -> Column:
    """Hex digits that only the holder of the key can draw."""
    seed = F.concat_ws("\x01", F.lit(key), type_, canon, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x02")), 256))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _join(parts: Column) -> Column:
    return F.array_join(parts, "")


def _like(s: Column, stream: Column) -> Column:
    """Each digit and letter by a drawn one of its class (hex digits, if there are no others); all else stays."""
    digit = lambda h: F.translate(h, "abcdef", "258147")
    letter = lambda h: F.translate(h, "0123456789abcdef", "bcdfghjklmnprstv")
    at = lambda i: F.substring(stream, F.pmod(i * 7, F.lit(128)) + 1, F.lit(1))
    hexes = s.rlike(r"\A(?=.*[a-f])[0-9a-f]{16,}\z")

    def one(hexed):  # an array of one, so that a long text is looked at once and not for each character
        return lambda c, i: F.when(hexed, at(i)).when(c.rlike("[0-9]"), digit(at(i))).when(c.rlike("[a-z]"), letter(at(i))).when(c.rlike("[A-Z]"), F.upper(letter(at(i)))).otherwise(c)

    return _join(F.flatten(F.transform(F.array(hexes), lambda hexed: F.transform(_chars(s), one(hexed)))))


def _luhn(body: Column) -> Column:
    """The check digit of a number whose other digits these are."""
    n = F.length(body)
    value = F.transform(_chars(body), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(10 - F.pmod(F.aggregate(value, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string")


def _iban(country: Column, body: Column) -> Column:
    """An IBAN with right check digits."""
    digits = lambda s: _join(F.transform(_chars(s), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))))
    rest = F.aggregate(_chars(F.concat(digits(F.concat(body, country)), F.lit("00"))), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def surrogate(key: str, e: Column, attempt: Column) -> Column:
    """The canonical form of what stands for an entity."""
    type_, canon = e["type"], e["canon"]
    draw, told = (attempt / _DRAW).cast("int"), F.pmod(attempt, F.lit(_DRAW))
    s = _stream(key, type_, canon, draw)
    like = _like(canon, s)
    more = (draw / 2).cast("int")
    letters = F.translate(F.substring(s, F.lit(90), more), "0123456789abcdef", "bcdfghjklmnprstv")
    digits = F.translate(s, "abcdef", "258147")
    hexes = lambda i: F.conv(F.substring(s, i, F.lit(4)), 16, 10).cast("int")
    ip = F.concat_ws(".", *[(F.pmod(hexes(F.lit(1 + 4 * k)), F.lit(223 if k == 0 else 254)) + 1).cast("string") for k in range(4)])
    # an area code and an exchange start with 2 to 9
    d = lambda a, k: F.substring(digits, a, k)
    high = lambda a: F.translate(d(a, 1), "01", "29")
    phone = F.when(F.length(canon) == 10, F.concat(high(1), d(2, 2), high(4), d(5, 2), d(7, 4))).otherwise(F.concat(high(1), F.substring(like, F.lit(2), F.length(canon))))
    card = F.concat(F.substring(canon, 1, 1), F.when(F.length(canon) == 16, d(1, 14)).otherwise(F.substring(like, F.lit(2), F.length(canon) - 2)))
    ssn = F.concat(F.translate(d(1, 1), "09", "12"), d(2, 2), F.translate(d(4, 1), "0", "5"), d(5, 5))
    email = F.concat(_like(F.regexp_extract(canon, r"\A(.*)(\.[^.]*)\z", 1), s), F.regexp_extract(canon, r"\A(.*)(\.[^.]*)\z", 2))
    script = _script(canon)
    woman = (told == _WOMAN) | ((told == 0) & _suggests_woman(canon))
    groups = F.transform(F.split(canon, ":"), lambda g, i: F.when((g == "") | (i == 0), g).otherwise(F.regexp_replace(F.substring(s, F.pmod(i * 7, F.lit(100)) + 1, F.length(g)), r"\A0", "a")))
    name = None
    for k, syllables in _SYLLABLES.items():
        table_ = F.array(*[F.lit(x) for x in syllables])
        at = F.sequence(F.lit(0), F.least(F.lit(30), more + 4))
        word = F.initcap(_join(F.transform(at, lambda i: F.get(table_, F.pmod(hexes(i * 4 + 1), F.lit(16))))))  # noqa: B023
        male, female, neither, family = _ENDS[k]
        word = F.concat(word, F.when(type_ == "family", family).when(told == _BOTH, neither).when(woman, female).otherwise(male))
        name = F.when(script == k, word) if name is None else name.when(script == k, word)
    return (
        F.when(type_ == "email", F.concat(letters, email)).when(type_ == "ip", ip).when(type_ == "ip6", F.array_join(groups, ":")).when(type_ == "phone", phone).when(type_ == "card", F.concat(card, _luhn(card)))
        .when(type_ == "ssn", ssn).when(type_ == "iban", _iban(F.substring(canon, 1, 2), _like(F.substring(canon, F.lit(5), F.length(canon)), s)))
        .when(type_ == "secret", F.concat(like, letters)).otherwise(name))


def _formed(kind: Column, raw: Column, sur: Column) -> Column:
    """The surrogate in the form of the raw text: separators where they were, capitals as they were."""
    digits = F.aggregate(_chars(raw), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["o"], F.substring(sur, a["k"], F.lit(1))).alias("o"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["k"].alias("k"))))["o"]
    digits = F.when((kind == "iban") & (raw == F.lower(raw)), F.lower(digits)).otherwise(digits)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), digits).when(kind.isin("email", "ip6") & (raw == F.upper(raw)), F.upper(sur)).otherwise(sur)


def _cased(raw: Column, sur: Column) -> Column:
    return F.when((F.length(raw) > 1) & (raw == F.upper(raw)), F.upper(sur)).otherwise(sur)


def replaced(key: str, m: Column, attempts: Column, kind: Column | None = None) -> Column:
    """What stands for a match. attempts: a map from `type|canonical` to the attempt, where that isn't 0."""
    kind = _kind(m) if kind is None else kind
    prefix = _prefix(kind, m)
    raw = F.substring(m, F.length(prefix) + 1, F.length(m))
    parts = F.transform(entities(m, kind), lambda e: F.struct(e["raw"].alias("raw"), surrogate(key, e, F.coalesce(F.element_at(attempts, F.concat_ws("|", e["type"], e["canon"])), F.lit(0))).alias("sur")))
    # a name that comes twice in a person's names has two surrogates at most: by the part's place
    tokens = _tokens(raw)
    place = lambda i: F.size(F.filter(F.slice(tokens, F.lit(1), i), _is_entity))
    initial = lambda t: F.concat(F.translate(F.upper(F.substring(_stream(key, F.lit("initial"), t, F.lit(0)), 1, 1)), "0123456789", "GHJKLMNPRS"), F.lit("."))
    named = F.transform(tokens, lambda t, i: F.when(t.rlike(r"\A\p{Lu}\.\z"), initial(t)).when(_is_entity(t), _cased(t, F.get(parts, place(i))["sur"])).otherwise(t))
    return F.when(kind == "none", m).otherwise(F.concat(prefix, F.when(kind == "person", F.array_join(named, " ")).otherwise(_formed(kind, raw, F.get(parts, F.lit(0))["sur"]))))


def _names(hits: Column) -> Column:
    """The distinct names of the matches that are persons, as entities, as they stand there and in canonical form; the longest first, so that Ann-Lee comes before Ann."""
    persons = F.filter(hits, lambda h: h["kind"] == "person")
    form = lambda e, raw: F.struct((-F.length(raw)).alias("n"), raw.alias("raw"), e["canon"].alias("canon"), e["type"].alias("type"))
    every = F.flatten(F.transform(persons, lambda h: entities(h["m"], h["kind"])))
    each = F.array_distinct(F.flatten(F.transform(every, lambda e: F.array(form(e, e["raw"]), form(e, e["canon"])))))
    return F.transform(F.array_sort(each), lambda e: F.struct(e["type"].alias("type"), e["canon"].alias("canon"), e["raw"].alias("raw")))


def _bare(names: Column) -> Column:
    """A pattern of the names as whole words. Names are letters, hyphens and apostrophes alone."""
    return F.concat(F.lit(r"(?<![\p{L}\d])(?:"), F.array_join(F.transform(names, lambda e: e["raw"]), "|"), F.lit(r")(?![\p{L}\d])"))


def _unnamed(gap: Column, pattern: Column, stands: Column) -> Column:
    """A stretch between matches, with the names replaced that stands has."""
    parts, own = F.split(gap, pattern, -1), F.regexp_extract_all(gap, pattern, F.lit(0))
    return F.concat(F.get(parts, F.lit(0)), _join(F.transform(own, lambda x, i: F.concat(F.element_at(stands, x), F.get(parts, i + 1)))))


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """Attempts, where not 0, of the distinct entities (type, canon, and gender if a title tells it), such that no two entities of a type share
    a surrogate and none is a real entity of the texts.

    Entities that collide are drawn again until none does; every second draw e-mail addresses, secrets and names are longer, so that
    there are enough. If numbers of a fixed length run out all the same, it is an error. Only whether any collide is collected.
    """
    if "gender" not in found.columns:
        found = found.withColumn("gender", F.lit(""))
    man, woman = F.coalesce(F.max(F.col("gender") == "m"), F.lit(False)), F.coalesce(F.max(F.col("gender") == "f"), F.lit(False))
    told = F.when(F.col("type") != "given", 0).when(F.col("__m") & F.col("__f"), _BOTH).when(F.col("__m") & _suggests_woman(F.col("canon")), _MAN).when(F.col("__f") & ~_suggests_woman(F.col("canon")), _WOMAN).otherwise(0)
    all_ = found.groupBy("type", "canon").agg(man.alias("__m"), woman.alias("__f")).select("type", "canon", told.alias("attempt"))
    all_ = materialise(all_.withColumn("sur", surrogate(key, F.struct("type", "canon"), F.col("attempt"))), "entities")
    real = all_.select(F.col("type").alias("__t"), F.col("canon").alias("__c"))
    now = all_
    for _ in range(ROUNDS):
        place = F.row_number().over(Window.partitionBy("type", "sur").orderBy("attempt", "canon"))
        marked = now.withColumn("__n", place).join(real, (F.col("type") == F.col("__t")) & (F.col("sur") == F.col("__c")), "left")
        again = marked.withColumn("__again", (F.col("__n") > 1) | F.col("__c").isNotNull())
        again = materialise(again.select("type", "canon", F.when(F.col("__again"), F.col("attempt") + _DRAW).otherwise(F.col("attempt")).alias("attempt"), "sur", "__again"), "entities")
        if not again.filter("__again").limit(1).count():
            return now.filter("attempt > 0").select("type", "canon", "attempt")
        now = again.withColumn("sur", F.when(F.col("__again"), surrogate(key, F.struct("type", "canon"), F.col("attempt"))).otherwise(F.col("sur"))).drop("__again")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} draws")


def _parted(text: Column) -> Column:
    """A text as stretches and matches in turn, from one pass of the patterns."""
    odd = text.contains(_MARK) | text.contains(_ESCAPE)
    safe = F.when(odd, F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE_IN)), F.lit(_MARK), F.lit(_MARK_IN))).otherwise(text)
    whole = lambda x: F.when(x.contains(_ESCAPE), F.replace(F.replace(x, F.lit(_MARK_IN), F.lit(_MARK)), F.lit(_ESCAPE_IN), F.lit(_ESCAPE))).otherwise(x)
    return F.transform(F.split(F.regexp_replace(safe, ANY, f"{_MARK}$0{_MARK}"), _MARK, -1), whole)


def pseudonymise(docs: DataFrame, key: str = "tessera", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replaces the text's entities by surrogates, and adds n_entities.

    Detected: secrets after their names, also as JSON keys (in quotes to the closing one, else to white space), e-mail addresses, IBANs
    (in small letters if their check digits are right), US social security numbers, card numbers (16 digits, or 13 to 19 that pass Luhn's
    check), phone numbers (3-3-4, ten digits, + or 00 and a country, or 0 and an area), IPv4 and IPv6 addresses, persons after a title, with
    all parts of their names, two names before an e-mail address made of them, and the same names elsewhere in that text. A surrogate is drawn from a keyed hash of type and canonical form, so
    the same entity has the same surrogate in all texts, forms and under all titles (coreference). It keeps separators, lengths, top-level
    domains, country codes, capitals, Luhn and IBAN check digits, and a name's script and the gender that its titles tell in all texts
    (neither, if they tell both). The distinct entities are checked: those that share a surrogate or hit a real entity are drawn again, see
    dictionary(). Texts are parted into entities and the rest once and written so; they are not shuffled unless they hold an entity that was
    drawn again or a given name whose ending misleads.

    A null text stays null with 0 entities; a text without entities stays as it is. Texts of any length are searched whole. Rows that repeat
    are treated alike. An empty table gives an empty result. An input column named n_entities, in any case, is replaced.
    """
    s = Shelter(docs)
    own, text = [c for c in s.df.columns if c != s(text_col)], s(text_col)
    parted = s.df.select(*own, _parted(F.col(text).cast("string")).alias("parts"), F.monotonically_increasing_id().alias("row"))
    odd = F.filter("parts", lambda x, i: i % 2 == 1)
    hits = F.when(F.size("parts") > 1, F.transform(odd, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))))
    rows = materialise(parted.select(*own, hits.alias("hits"), F.filter("parts", lambda x, i: i % 2 == 0).alias("gaps"), "row"), "parts")
    seen = rows.select(F.explode("hits").alias("h")).filter("h.kind <> 'none'").select("h.*").distinct()
    found = seen.select(F.explode(entities(F.col("m"), F.col("kind"))).alias("e")).select("e.type", "e.canon", "e.gender").distinct()
    again = materialise(dictionary(found, key), "again")
    none = F.expr("cast(map() as map<string, int>)")

    def rewritten(df, attempts):
        df = df.select(*own, "hits", "gaps", attempts.alias("attempts"), F.when(F.exists("hits", lambda h: h["kind"] == "person"), _names(F.col("hits"))).alias("names"))
        named = F.col("names").isNotNull()
        drawn = lambda e: _cased(e["raw"], surrogate(key, e, F.coalesce(F.element_at("attempts", F.concat_ws("|", e["type"], e["canon"])), F.lit(0))))
        first = F.filter("names", lambda e, i: (i == 0) | (F.get(F.col("names"), i - 1)["raw"] != e["raw"]))
        df = df.withColumns({"bare": F.when(named, _bare(F.col("names"))), "stands": F.when(named, F.map_from_entries(F.transform(first, lambda e: F.struct(e["raw"], drawn(e)))))})
        repeats = F.aggregate("gaps", F.lit(0), lambda a, g: a + F.size(F.regexp_extract_all(g, F.col("bare"), F.lit(0))))
        n = F.size(F.filter("hits", lambda h: h["kind"] != "none")) + F.when(named, repeats).otherwise(0)
        gap = lambda g: F.when(named, _unnamed(g, F.col("bare"), F.col("stands"))).otherwise(g)
        new = F.concat(gap(F.get("gaps", F.lit(0))), _join(F.transform("hits", lambda h, i: F.concat(replaced(key, h["m"], F.col("attempts"), h["kind"]), gap(F.get(F.col("gaps"), i + 1))))))
        out = df.select(*own, F.when(F.col("hits").isNotNull(), new).otherwise(F.get("gaps", F.lit(0))).alias(text), F.when(F.col("hits").isNotNull(), n).otherwise(0).alias("n_entities"))
        return s.back(out, "n_entities")

    if not again.limit(1).count():
        return rewritten(rows, none)
    theirs = rows.select(F.col("row").alias("r"), F.explode(F.array_distinct(F.flatten(F.transform("hits", lambda h: entities(h["m"], h["kind"]))))).alias("e")).select("r", "e.type", "e.canon").distinct()
    theirs = theirs.join(again, ["type", "canon"]).groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "type", "canon"), "attempt"))).alias("map"))
    return rewritten(rows.join(theirs, F.col("row") == F.col("r"), "left"), F.coalesce("map", none))


def op4_pii(spark, sf_dir):
    """All documents with surrogates for their personal data."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(d).select("doc_id", "n_entities", "text")
