"""Surrogates for personal data, in DataFrame functions only.

Detected entities (local parts and domains of mail addresses, phone, card and account numbers, identity
numbers, IBANs, IP addresses, secrets, titled names and their words without a title in the same text) are
reduced to a canonical form, so that one person's number written in two ways is one entity. Each distinct
entity gets one surrogate from a keyed digest: same kind, script, gender and length, with valid check digits.
Surrogates are checked against each other and against the
real entities of their kind; those that collide are drawn again. Each mention is then written with
its entity's surrogate in the mention's own format.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, saved, table, without

KEY = "tallyspark-surrogates"
ROUNDS = 12
#: Numbers of a kind and length are dense from one entity in so many values on.
DENSE = 64
#: So many more redraws, of which each parts nearly all where a kind isn't dense.
FAIL = 40

# Forms of address by gender, before which a name stands.
MALE = ["Mister", "Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н", "κύριος"]
FEMALE = ["Mrs", "Miss", "Ms", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Signora", "госпожа", "г-жа", "κυρία"]
NEUTRAL = ["Dr", "Doctor", "Prof", "Professor"]
PARTICLES = "van von der den de del da di dos la le zu bin al".split()

# Parts that surrogate names are made of, by script.
STARTS = {
    "latin": ["Al", "Ber", "Cor", "Dan", "El", "Fer", "Gar", "Hel", "Jor", "Kas", "Lor", "Mar", "Nor", "Or", "Per", "Ros", "Sal", "Tor", "Val", "Wil"],
    "cyrillic": ["Ал", "Бор", "Вал", "Гер", "Дан", "Зор", "Кир", "Лад", "Мар", "Нор", "Пол", "Рад", "Сав", "Тим", "Фед", "Яр"],
    "greek": ["Αλ", "Βασ", "Γερ", "Δαμ", "Ελ", "Θεο", "Καλ", "Λεω", "Μαρ", "Νικ", "Πετ", "Σταυ"],
}
MIDDLES = {
    "latin": ["an", "bel", "den", "er", "fin", "gil", "is", "lan", "mir", "on", "ran", "sen", "tin", "ul", "ven", "wyn"],
    "cyrillic": ["ан", "бел", "ден", "ер", "ил", "ин", "лан", "мир", "он", "ран", "сел", "тин"],
    "greek": ["αν", "βελ", "δεν", "ερ", "ιλ", "λαν", "μιρ", "ον", "ραν", "τιν"],
}
ENDS = {
    ("latin", "m"): ["ard", "as", "ek", "en", "ik", "o", "or", "us"],
    ("latin", "f"): ["a", "elle", "ena", "ia", "ina", "isa", "itta", "ynne"],
    ("latin", "family"): ["berg", "ell", "ford", "holt", "ini", "mann", "os", "ova", "sen", "ton", "vic", "worth"],
    ("cyrillic", "m"): ["ад", "ей", "ий", "ислав", "ор"],
    ("cyrillic", "f"): ["а", "ена", "ина", "ия", "яна"],
    ("cyrillic", "family"): ["енко", "ич", "ко", "ский", "ук"],
    ("greek", "m"): ["ας", "ης", "ος", "ων"],
    ("greek", "f"): ["α", "ενα", "η", "ινα"],
    ("greek", "family"): ["ακης", "ιδης", "οπουλος", "ου"],
}

ENDS |= {(x, "u"): ENDS[x, "m"] + ENDS[x, "f"] for x in STARTS}

_titles = lambda titles: "(?:" + "|".join(sorted({v for t in titles for v in (t, t.upper())}, key=lambda t: (-len(t), t))) + r")\.? "
# Every repetition below is possessive or of a bounded number, and every form starts where no letter or digit of its
# kind goes before it: the time is linear in the text, and no loop of the pattern engine recurses with its length.
_TITLE = "(?=[" + "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL})) + "])(?:" + _titles(MALE + FEMALE + NEUTRAL) + "){1,4}+"
_MIXED = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}[\p{L}\p{M}]*+(?:[-'’]\p{Lu}[\p{L}\p{M}]++)*+"
_CAPS = r"\p{Lu}['’]?\p{Lu}++(?:[-'’]\p{Lu}{2,}+)*+(?!\p{L})"
_PLAIN = r"(?:\p{Lu}\.|" + "|".join(PARTICLES) + ")"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]++\.){1,126}\p{L}{2,}+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<!\+)(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\+)(?:\+\d{1,3}[ .-]?)?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<!\+)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])|(?<![.,-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![\w-]|[.,]\d)|(?<![.,-])(?:[2-9]\d{9}|0\d{9,10})(?![\w-]|[.,]\d)"
CARD = r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{3}(?![\w(-]|[ .]\d))?|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w)"
IP6 = r"(?=[0-9A-Fa-f]{1,4}:)(?<![:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,40}\d|[A-Fa-f:]{0,40}[A-Fa-f]{4})[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
SECRET = r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+)(?!\w)"
#: A title and all words of the name, with initials and particles between; of words in capitals three at most, as
#: a whole sentence may be in capitals.
_NEXT = f"(?!{_titles(MALE + FEMALE + NEUTRAL)})"
NAMED = rf"(?<!-){_TITLE}{_NEXT}(?:(?:{_PLAIN} )*+{_MIXED}(?: (?:{_PLAIN} )*+{_NEXT}(?:{_MIXED}|{_CAPS}))*+|(?:{_PLAIN} )*+{_CAPS}(?: (?:{_PLAIN} )*+{_NEXT}{_CAPS}){{0,2}}+)"
PATTERN = rf"{EMAIL}|(?<!\w)(?:" + "|".join([SECRET, IBAN, SSN, PHONE, CARD, IP, IP6, NAMED]) + ")"
TITLED = rf"(?<!\w){NAMED}"
#: Capitalised words, which in a text with titled names may be those names' words.
WORD = r"(?<![\p{L}\p{M}\p{N}_])\p{Lu}[\p{L}\p{M}]++(?![\p{N}_])"
#: Texts that neither hold one of these characters nor begin a word so can't hold an entity, a cheap first look: mail
#: needs @; IBANs, numbers and IPs a digit, IPv6 a digit or colons; of secrets and names what they begin with.
HINT = r"[@\d]", r"::|(?<!\w)(?:(?:[A-Fa-f]{1,4}:){7}|[a-f]{32}|[A-F]{32}|AKIA|ASIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]|" + _TITLE + ")"
#: Control characters that stand for the bounds of a mention; where a text has them they are escaped.
_CUT, _ESC = "\x01", "\x02"


def _parts(t: Column) -> Column:
    """A text in parts, by one scan: those at odd places are mentions, or capitalised words where it has titled names."""
    safe = F.replace(F.replace(t, F.lit(_ESC), F.lit(_ESC + "\x03")), F.lit(_CUT), F.lit(_ESC + "\x04"))
    cut = lambda pattern: F.regexp_replace(safe, f"({pattern})", f"{_CUT}$1{_CUT}")
    return F.split(F.when(t.rlike(TITLED), cut(f"{PATTERN}|{WORD}")).otherwise(cut(PATTERN)), _CUT, -1)


def _joined(parts: Column) -> Column:
    whole = F.array_join(parts, "")
    return F.replace(F.replace(whole, F.lit(_ESC + "\x04"), F.lit(_CUT)), F.lit(_ESC + "\x03"), F.lit(_ESC))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _part(kind: Column, raw: Column) -> Column:
    return F.struct(kind.alias("kind"), raw.alias("raw"))


def _words(m: Column) -> Column:
    """The runs of letters of a titled name and what stands between them, as parts (kind, raw). The runs of the last
    word are family names; particles and initials stay."""
    title = F.regexp_extract(m, f"^{_TITLE}", 0)
    name = F.regexp_replace(m, f"^{_TITLE}", "")
    gender = F.when(title.rlike("(^| )" + _titles(FEMALE)), "f").when(title.rlike("(^| )" + _titles(MALE)), "m").otherwise("u")
    runs = lambda x: F.split(F.regexp_replace(x, r"([\p{L}\p{M}]{2,}+)", f"{_CUT}$1{_CUT}"), _CUT, -1)
    pieces, last = runs(name), F.size(runs(F.regexp_extract(name, "[^ ]*+$", 0)))

    def one(w: Column, i: Column, known: Column) -> Column:
        role = F.when(i > known["before"], F.concat(F.lit("family:"), _script(w))).otherwise(F.concat(F.lit("given:"), known["gender"], F.lit(":"), _script(w)))
        return _part(F.when((i % 2 == 0) | F.lower(w).isin(PARTICLES), "").otherwise(role), w)

    # one struct, so that what the whole name gives isn't computed again for each word
    whole = F.array(F.struct(pieces.alias("pieces"), (F.size(pieces) - last).alias("before"), gender.alias("gender")))
    return F.concat(F.array(_part(F.lit(""), title)), F.flatten(F.transform(whole, lambda known: F.transform(known["pieces"], lambda w, i: one(w, i, known)))))


def _segments(m: Column) -> Column:
    """A mention as parts (kind, raw); kind is empty for what stays as it is, `word` for a capitalised word without
    a title. Plain numbers of a card's length are cards if their check digit is right, grouped ones always."""
    kind = (
        F.when(m.contains(":"), "ip6")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^([0-9a-f]{32,64}|[0-9A-F]{32,64})$"), "hex")
        .when(m.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^(sk|pk|gh[po]|xox[bp])[-_]"), "secret")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\p{L}"), "word")
        .when(m.rlike(r"^[+(]") | (F.length(_digits(m)) < 13), "phone")
        .otherwise(F.when(m.rlike("[ -]") | (_luhn_of(m) % 10 == 0), "card").otherwise(""))
    )
    mail = F.array(_part(F.lit("local"), F.split_part(m, F.lit("@"), F.lit(1))), _part(F.lit(""), F.lit("@")), _part(F.lit("domain"), F.split_part(m, F.lit("@"), F.lit(2))))
    return F.when(m.contains("@"), mail).when(m.rlike(f"^{_TITLE}"), _words(m)).otherwise(F.array(_part(kind, m)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


#: SQL: an IPv6 address as eight groups of four digits.
_GROUPS = """array_join(transform(concat(filter(split(split(lower(raw), '::')[0], ':'), g -> g <> ''),
    if(raw like '%::%', array_repeat('0', greatest(0, 8 - size(filter(split(raw, ':'), g -> g <> '')))), array()),
    filter(split(coalesce(get(split(lower(raw), '::'), 1), ''), ':'), g -> g <> '')), g -> lpad(g, 4, '0')), ':')"""


def _canon(kind: Column, raw: Column) -> Column:
    """What all mentions of one entity have in common."""
    return (
        F.when(kind == "phone", F.expr("right(regexp_replace(raw, '[^0-9]', ''), 10)"))
        .when(kind.isin("card", "ssn"), _digits(raw))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind.isin("ip", "hex", "secret"), raw)
        .when(kind == "ip6", F.expr(_GROUPS))
        .otherwise(F.lower(raw))
    )


def _pick(values: list[str], at: Column) -> Column:
    array = F.array(*[F.lit(v) for v in values])
    return F.element_at(array, (at % len(values) + 1).cast("int"))


def _byte(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")


_CHARS = """
array_join(transform(filter(split({x}, ''), c -> c <> ''), (c, i) -> case
  when c rlike '[0-9]' then substr('0123456789', conv(substr(h, 2 * (i % 32) + 1, 2), 16, 10) % 10 + 1, 1)
  when c rlike '[a-z]' then substr('{low}', conv(substr(h, 2 * (i % 32) + 1, 2), 16, 10) % {n} + 1, 1)
  when c rlike '[A-Z]' then upper(substr('{low}', conv(substr(h, 2 * (i % 32) + 1, 2), 16, 10) % {n} + 1, 1))
  when c rlike '[\\\\p{{IsCyrillic}}]' then substr('абвгдежзиклмнопрстуфхцчшэюя', conv(substr(h, 2 * (i % 32) + 1, 2), 16, 10) % 27 + 1, 1)
  when c rlike '[\\\\p{{IsGreek}}]' then substr('αβγδεζηθικλμνξοπρστυφχψω', conv(substr(h, 2 * (i % 32) + 1, 2), 16, 10) % 24 + 1, 1)
  when c rlike '[\\\\p{{L}}]' then substr('{low}', conv(substr(h, 2 * (i % 32) + 1, 2), 16, 10) % {n} + 1, 1)
  else c end), '')"""
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits, its last digit the check digit."""
    return f"""aggregate(transform(sequence(1, length({digits})), i -> case
      when i % 2 = 1 then cast(substr(reverse({digits}), i, 1) as int)
      else cast(substr(reverse({digits}), i, 1) as int) * 2 - if(cast(substr(reverse({digits}), i, 1) as int) > 4, 9, 0) end), 0, (a, x) -> a + x)"""


def _luhn_of(digits: Column) -> Column:
    """The Luhn sum of a column of digits."""
    number = lambda x: F.ascii(x) - 48
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(x == "", 0).when(i % 2 == 0, number(x)).otherwise(2 * number(x) - F.when(number(x) > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


#: SQL: the remainder by 97 of an account number whose letters count as 10 to 35.
_REST = "aggregate(filter(split({x}, ''), c -> c <> ''), 0L, (a, c) -> if(c between '0' and '9', a * 10 + ascii(c) - 48, a * 100 + ascii(c) - 55) % 97)"


def _surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, attempt) with column sur, the canonical form of the surrogate."""
    h = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 256)
    d = entities.withColumn("h", h).withColumn("numbers", F.translate(F.concat("h", F.sha2("h", 256)), "abcdef", "271828"))
    local = F.expr(_CHARS.format(x="canon", low=_LETTERS, n=26))
    host = F.expr(_CHARS.format(x="substring_index(canon, '.', size(split(canon, '[.]')) - 1)", low=_LETTERS, n=26))  # the last label stays
    more = F.when(F.col("attempt") >= 4, F.expr("substr(numbers, 60, least(2 + attempt, 60))")).otherwise("")
    ip = F.concat_ws(".", (_byte(F.col("h"), 0) % 223 + 1).cast("string"), *[_byte(F.col("h"), i).cast("string") for i in (1, 2, 3)])
    body = F.expr("substr(numbers, 1, length(canon) - 1)")
    d = d.withColumn("body", body)
    valid = F.expr(f"{_luhn('canon')} % 10 = 0")
    check = F.expr(f"cast((10 - {_luhn(chr(99) + 'oncat(body, chr(48))')} % 10) % 10 as string)")
    card = F.concat("body", F.when(valid, check).otherwise(F.expr("substr(numbers, length(canon), 1)")))
    d = d.withColumn("account", F.expr(_CHARS.format(x="substring(canon, 5)", low=_LETTERS, n=26)))
    land = F.substring("canon", 1, 2)
    iban = F.concat(land, F.expr("lpad(cast(98 - " + _REST.format(x="concat(account, substr(canon, 1, 2), '00')") + " as string), 2, '0')"), "account")

    def name(script: str, role: str) -> Column:
        middles = "array(" + ", ".join(f"'{m}'" for m in MIDDLES[script]) + ")"
        extra = F.when(F.col("attempt") >= 3, F.expr(f"array_join(transform(sequence(1, least(2 * (attempt - 2), 28)), i -> element_at({middles}, cast(conv(substr(h, 2 * i + 7, 2), 16, 10) % {len(MIDDLES[script])} + 1 as int))), '')")).otherwise("")
        return F.lower(F.concat(_pick(STARTS[script], _byte(F.col("h"), 0)), _pick(MIDDLES[script], _byte(F.col("h"), 1)), extra, _pick(ENDS[script, role], _byte(F.col("h"), 2))))

    names = reduce(
        lambda w, c: w.when(F.col("kind") == (f"family:{c[0]}" if c[1] == "family" else f"given:{c[1]}:{c[0]}"), name(*c)),
        list(ENDS)[1:],
        F.when(F.col("kind") == "given:m:latin", name("latin", "m")),
    )
    sur = (
        F.when(F.col("kind") == "local", F.concat(local, more))
        .when(F.col("kind") == "domain", F.concat(host, more, F.lit("."), F.substring_index("canon", ".", -1)))
        .when(F.col("kind") == "ip", ip)
        .when(F.col("kind") == "ip6", F.expr("array_join(transform(sequence(0, 7), i -> substr(h, 4 * i + 1, 4)), ':')"))
        .when(F.col("kind") == "hex", F.when(F.col("canon").rlike("[A-F]"), F.upper(F.expr(_CHARS.format(x="canon", low="abcdef", n=6)))).otherwise(F.expr(_CHARS.format(x="canon", low="abcdef", n=6))))
        .when(F.col("kind") == "secret", F.concat(F.expr("regexp_extract(canon, '^(AKIA|ASIA|[a-z]+[-_])', 1)"), F.expr(_CHARS.format(x="regexp_replace(canon, '^(AKIA|ASIA|[a-z]+[-_])', '')", low=_LETTERS, n=26)), more))
        .when(F.col("kind") == "iban", iban)
        .when(F.col("kind") == "card", card)
        .when(F.col("kind").isin("phone", "ssn"), F.expr("substr(numbers, 1, length(canon))"))
        .otherwise(names)
    )
    return d.select("kind", "canon", "attempt", sur.alias("sur"))


def _ranked(df: DataFrame, name: str) -> DataFrame:
    """df with rank, 0 and up within each class, without a task that holds a class."""
    placed = saved(df.repartition("cls", F.pmod(F.xxhash64("value"), F.lit(16))).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    first = placed.groupBy("cls", "part").agg(F.min("at").alias("low"))
    within = placed.withColumn("k", F.row_number().over(Window.partitionBy("cls", "part").orderBy("at")) - 1)
    counts = within.groupBy("cls", "part").agg(F.count("*").alias("n")).join(first, ["cls", "part"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return within.join(counts.select("cls", "part", before.alias("before")), ["cls", "part"]).select("cls", "value", (F.col("k") + F.col("before")).alias("rank"))


def _exact(rest: DataFrame, current: DataFrame, entities: DataFrame, dense: list[tuple[str, int]]) -> DataFrame:
    """rest (kind, canon), of digits, each with a free value of its kind and length, by rank."""
    spark = rest.sparkSession
    cls = F.concat_ws("/", "kind", F.length("canon").cast("string"))
    space = reduce(
        lambda x, y: x.unionByName(y),
        [spark.range(10**n).select(F.lit(f"{kind}/{n}").alias("cls"), F.lpad(F.col("id").cast("string"), n, "0").alias("value")) for kind, n in dense],
    )
    kept = current.join(rest.select("kind", "canon"), ["kind", "canon"], "left_anti").select(cls.alias("cls"), F.col("sur").alias("value"))
    taken = kept.unionByName(entities.select(cls.alias("cls"), F.col("canon").alias("value")))
    free = _ranked(space.join(taken, ["cls", "value"], "left_anti"), "free")
    out = saved(_ranked(rest.select(cls.alias("cls"), F.col("canon").alias("value")), "rest").withColumnRenamed("value", "canon").join(free.withColumnRenamed("value", "sur"), ["cls", "rank"], "left"), "assigned")
    if lacking := out.where("sur is null").count():
        raise ValueError(f"{lacking} entities of {dense} have no free surrogate: their kinds have more entities than values")
    return out.select(F.split_part("cls", F.lit("/"), F.lit(1)).alias("kind"), "canon", F.lit(0).alias("attempt"), "sur")


def resolve(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """entities (kind, canon), distinct, with their surrogates (sur), different from each other and
    from every entity of their kind.

    Of entities that drew one surrogate, the one first by digest keeps it, the others draw again; so
    does each whose surrogate is an entity. Only the redrawn are carried from round to round, and rounds
    end when none collide. Names, local parts and secrets grow with the attempts. Phone and identity numbers
    that still collide after `rounds` rounds and are dense (DENSE) get the free values of their length by rank;
    where there are too few, or FAIL more rounds don't part the others, this fails.
    """
    current = saved(_surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    for done in range(rounds + FAIL + 1):
        first = F.min(F.sha2(F.col("canon"), 256))
        twice = current.groupBy("kind", "sur").agg(first.alias("keeps"), F.count("*").alias("n")).where("n > 1")
        again = current.join(twice, ["kind", "sur"]).where(F.sha2("canon", 256) != F.col("keeps")).select("kind", "canon", "attempt")
        real = current.join(entities.select("kind", F.col("canon").alias("sur")), ["kind", "sur"], "left_semi").select("kind", "canon", "attempt")
        redo = saved(again.unionByName(real).distinct().withColumn("attempt", F.col("attempt") + 1), "redraw")
        if redo.isEmpty():
            discard(redo)
            return current.select("kind", "canon", "sur")
        kept = current.join(redo.select("kind", "canon"), ["kind", "canon"], "left_anti")
        new = _surrogates(redo, key)
        if done == rounds:
            length = F.length("canon")
            sizes = entities.where(F.col("kind").isin("phone", "ssn")).groupBy("kind", length.alias("n")).count().collect()
            dense = [(r.kind, r.n) for r in sizes if 10**r.n <= DENSE * r["count"]]
            if dense:
                here = F.concat_ws("/", "kind", length.cast("string")).isin([f"{k}/{n}" for k, n in dense])
                new = _surrogates(redo.where(~here), key).unionByName(_exact(redo.where(here), current, entities, dense))
        before, current = current, saved(kept.unionByName(new), "surrogates")
        discard(before, redo)
    raise ValueError(f"surrogates still collide after {rounds + FAIL} redraws")


def _render() -> Column:
    """A surrogate in the format of its mention; columns kind, raw, sur."""
    spread = """array_join(transform(filter(split(raw, ''), c -> c <> ''), (c, i) -> if(c rlike '[0-9]' and place(raw, i) > 0, substr(sur, place(raw, i), 1), c)), '')"""
    # the place among the surrogate's digits: a phone number keeps digits before its last ten
    place = "length(regexp_replace(substr(raw, 1, i + 1), '[^0-9]', '')) - (length(regexp_replace(raw, '[^0-9]', '')) - length(sur))"
    grouped = "array_join(transform(filter(split(raw, ''), c -> c <> ''), (c, i) -> if(c = ' ', c, substr(sur, length(replace(substr(raw, 1, i + 1), ' ', '')), 1))), '')"
    return (
        F.when(F.col("kind") == "", F.col("raw"))
        .when(F.col("kind").isin("phone", "card", "ssn"), F.expr(spread.replace("place(raw, i)", place)))
        .when(F.col("kind") == "iban", F.expr(grouped))
        .when(F.col("kind").isin("ip", "ip6", "hex", "secret"), F.col("sur"))
        .when(F.col("kind").isin("local", "domain"), F.when(F.col("raw") == F.upper("raw"), F.upper("sur")).otherwise(F.col("sur")))
        .otherwise(F.when((F.length("raw") > 1) & (F.col("raw") == F.upper("raw")), F.upper("sur")).otherwise(F.initcap("sur")))
    )


def surrogates(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """docs with the entities in their texts replaced, and pii_count, the number of mentions replaced.

    Row for row and column for column as docs; a column pii_count of docs is replaced. One entity has
    one surrogate in all texts; equal texts stay equal, and an empty docs gives an empty result. Null texts stay
    null, texts without entities stay as they are, count 0. Texts are scanned once, in time linear in their length,
    whatever they hold, and written with their mentions marked; only those with mentions are shuffled, by their digest.
    The same key gives the same surrogates unless other entities collide.
    """
    docs = without(docs, ["pii_count"])
    t, sha, parts = F.col(f"`{text}`"), "__pii_sha", "__pii_parts"
    cut = docs.withColumn(parts, F.when(t.rlike(HINT[0]) | t.rlike(HINT[1]), _parts(t)))
    held = cut.withColumn(parts, F.when(F.size(parts) > 1, F.col(parts))).withColumn(sha, F.when(F.col(parts).isNotNull(), F.sha2(t, 256)))
    held = saved(held.select(*[F.when(F.col(parts).isNull(), t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], parts, sha), "texts")
    clean, dirty = held.where(f"{parts} is null").drop(parts, sha).withColumn("pii_count", F.lit(0)), held.where(f"{parts} is not null")
    texts = dirty.groupBy(F.col(sha).alias("sha")).agg(F.first(parts).alias("parts"))
    marks = texts.select("sha", F.posexplode("parts").alias("i", "m")).where("i % 2 = 1")
    segments = saved(marks.select("sha", "i", F.posexplode(_segments(F.col("m"))).alias("j", "s")).select("sha", "i", "j", F.col("s.kind").alias("kind"), F.col("s.raw").alias("raw")), "segments")
    # a name's word has one kind throughout its text, titled or not: that of its first titled mention
    named = segments.where("kind like 'given:%' or kind like 'family:%'")
    known = named.groupBy(F.col("sha").alias("in_sha"), F.lower("raw").alias("w")).agg(F.min_by("kind", F.struct("i", "j")).alias("named"))
    joined = segments.join(known, (F.lower("raw") == F.col("w")) & (F.col("sha") == F.col("in_sha")) & F.col("kind").rlike("^(word|given:|family:)"), "left")
    typed = joined.select("sha", "i", "j", "raw", F.coalesce("named", F.when(F.col("kind") == "word", "").otherwise(F.col("kind"))).alias("kind")).withColumn("canon", _canon(F.col("kind"), F.col("raw")))
    typed = saved(typed, "mentions")
    discard(segments)
    entities = resolve(saved(typed.where("kind <> ''").select("kind", "canon").distinct(), "entities"), key)
    pieces = typed.join(entities, ["kind", "canon"], "left").select("sha", "i", F.struct("j", _render().alias("piece")).alias("p"), (F.col("kind") != "").alias("hit"))
    mention = pieces.groupBy("sha", "i").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("hit").alias("hit"))
    filled = mention.groupBy(F.col("sha").alias("__pii_key")).agg(F.array_sort(F.collect_list(F.struct("i", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("piece")))).alias("__pii_pieces"), F.count_if("hit").cast("int").alias("pii_count"))
    done = dirty.join(filled, F.col(sha) == F.col("__pii_key"))
    whole = _joined(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get("__pii_pieces", F.floor(i / 2).cast("int"))["piece"])))
    return clean.unionByName(done.select(*[whole.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], "pii_count"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = surrogates(table(spark, sf_dir, "documents"))
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))
