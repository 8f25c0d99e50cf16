"""PII: detected entities are replaced by keyed surrogates of the same type, gender, script and format.

Entities are found by patterns: e-mail addresses, IPv4 addresses, payment cards, phone numbers,
identity numbers, and names behind a title; a name found so is found again in the same text without its title, whole or
by its family name. Each distinct entity of the corpus gets one surrogate, so mentions stay coreferent across documents. Names
are entities word by word, so "Mr Smith", "Dr Smith" and "John Smith" keep one family name:

- digits become digits and letters become letters of the same script, in place; a mention in capitals gets capitals;
- a card keeps its first digit, and its check digit stays as right or wrong as it was;
- an address keeps each octet below 256; a phone keeps its country code; e-mail keeps the
  number of labels, and equal domains stay equal;
- a title's gender and the name's script choose the names, at first from lists, then made of syllables,
  of which there are more with each attempt.

A surrogate is an HMAC of (type, entity, attempt) under a key that the caller must give. Entities of whatever type that would
share a surrogate, or whose surrogate is some entity of the corpus, are told apart by a check over the
distinct entities: the first keeps it, the others go on to the next attempt. Only numbers of a format that
has fewer forms than the corpus has entities can be left after `attempts` rounds; they get a 64-bit hash appended
behind a mark.

Defined cases: null text stays null and has no entities; repeated rows get the same surrogates;
an entity is compared in lower case with single spaces, one of numbers by its digits and plus sign, so
that a number written in another way is the same entity and keeps that way of writing; a given name with titles of
both genders, or none, gets a neutral one; empty input gives empty output.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept
from .spans import matches, matches_if

ATTEMPTS = 16

_NAME = r"(?:\p{Lu}[\p{Ll}'’-]+)(?:\x20\p{Lu}[\p{Ll}'’-]+){0,2}"
MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Don|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Lady|Frau|Madame|Mademoiselle|Señora|Señorita|Sra|Srta|Doña|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Mx"
#: (type, pattern), in order of preference where two begin at the same place.
TYPES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d|\d)"),
    ("phone", r"(?<![\d+])\+\d{1,3}[\x20.-]?\(?\d{2,4}\)?(?:[\x20.-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\)\x20?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])(?:\d{4}[\x20-]){3}\d{4}(?![\d-])|(?<!\d)\d{13,19}(?!\d)"),
    ("identity", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<!\d)\d{9}(?!\d)"),
    ("name", rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.?\x20{_NAME}"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in TYPES)
#: Cheap to test before PATTERN, of which any match holds one of these.
GATE = rf"@[A-Za-z0-9-]|\+\d{{3}}|\d{{9}}|\d[.-]\d|\(\d|\d\x20\d|\d\x20\(|(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.?\x20\p{{Lu}}"

#: Given names and family names, by script and gender.
GIVEN = {
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth Joshua Kevin Brian",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Donna Michelle Carol",
    ("latin", "n"): "Alex Jordan Taylor Morgan Casey Riley Jamie Avery Quinn Robin Rowan Sasha Kim Lee Dana Jean Jesse Kerry Leslie Pat",
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Максим Иван Михаил Николай Павел",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина",
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура Паша Никита Миша Лёша Тоня",
    ("greek", "m"): "Γιώργος Κώστας Δημήτρης Γιάννης Νίκος Παναγιώτης Βασίλης Χρήστος Αντώνης Πέτρος",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Άννα Ιωάννα",
    ("greek", "n"): "Αλεξ Νικ Χρις Σταυ Παν Δημ Κων Γεω Βασ Σωτ",
}
FAMILY = {
    "latin": "Smith Johnson Williams Brown Jones Garcia Miller Davis Martinez Lopez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Clark Lewis Walker Hall Young King Wright Hill",
    "cyrillic": "Иваненко Петренко Сидоренко Кравченко Шевченко Бондаренко Ткаченко Коваленко Олейник Лысенко",
    "greek": "Παππάς Νικολάου Δημητρίου Γεωργίου Ιωάννου Βασιλείου Χρήστου Αντωνίου Πέτρου Σωτηρίου",
}


#: Onsets, vowels and endings (by gender; "s" of family names) of made names.
SYLLABLES = {
    "latin": ("b d f g h j k l m n p r s t v w br dr gr kl pl st tr th", "a e i o u", {"m": "n rt ld us mond ric", "f": "a ia elle ine ette isa", "n": "y ie is ey en al", "s": "son man ley ton er well ford berg sen ski"}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х", "а е и о у", {"m": "р н слав мир дан тин", "f": "на ля ра ша ина ия", "n": "ша ня ся ля ка чи", "s": "енко ук чук ец ян ко"}),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ", "α ε ι ο υ", {"m": "ς νος τος ρης λης δης", "f": "α νη ρα λια σια τα", "n": "ν ξ ψ λ ρ ι", "s": "πουλος ιδης ακης ογλου ατος ινης"}),
}


def _kind(s: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(TYPES[:-1]):
        out = F.when(s.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


_TITLE = rf"^(?:{MALE}|{FEMALE}|{NEUTRAL})\.?\x20"


def mentions(text: Column) -> Column:
    """array<struct<start, end, s>> of a text, in order."""
    found = matches_if(text.rlike(GATE) & text.rlike(PATTERN), text, PATTERN)

    def echoes(all_: Column) -> Column:
        """Names without their titles, and family names, wherever no other entity stands."""
        bare = F.transform(F.filter(all_, lambda m: m["s"].rlike(_TITLE)), lambda m: F.regexp_replace(m["s"], _TITLE, ""))
        listed = F.array_distinct(F.concat(F.filter(bare, lambda n: n.contains(" ")), F.filter(F.transform(bare, lambda n: F.substring_index(n, " ", -1)), lambda n: F.length(n) > 2)))
        longest = F.transform(F.array_sort(F.transform(listed, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda n: n["n"])
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))
        more = F.filter(matches(text, pattern), lambda m: ~F.exists(all_, lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"])))
        return F.when(F.size(listed) > 0, F.array_sort(F.concat(all_, more))).otherwise(all_)

    return F.transform(F.array(found), lambda all_: F.when(F.exists(all_, lambda m: m["s"].rlike(_TITLE)), echoes(all_)).otherwise(all_))[0]


#: Types whose entities are compared by their digits.
NUMBERS = ("phone", "card", "identity")


def canonical(kind: Column, s: Column) -> Column:
    return F.when(kind.isin(*NUMBERS), F.regexp_replace(s, "[^0-9+]", "")).otherwise(F.lower(F.regexp_replace(s, r"\s+", " ")))


def filled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced, in order, by others."""
    each = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(F.substring(form, i, F.lit(1)).between("0", "9"), F.substring(digits, F.length(F.regexp_replace(F.substring(form, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(F.substring(form, i, F.lit(1))))
    return F.array_join(each, "")


def _number(digest: Column, at: int, width: int) -> Column:
    """A number from hex digits of a digest."""
    return F.conv(F.substring(digest, at, width), 16, 10).cast("long")


def _shape(s: Column, digest: Column) -> Column:
    """Each digit and letter replaced by one of its kind; the digest decides, again from its start if it is used up."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / 16).cast("int")), lambda k: F.sha2(F.concat(digest, k.cast("string")), 256))

    def one(c: Column, i: Column, block: Column) -> Column:
        n = F.conv(F.substring(F.get(block, F.floor(i / 16).cast("int")), (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return (
            F.when(c.between("0", "9"), pick("0123456789")).when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.between("а", "я") | (c == "ё"), pick("абвгдежзийклмнопрстуфхцчшщэюя")).when(c.between("А", "Я") | (c == "Ё"), pick("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ")).when(c.between("α", "ω"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
            .otherwise(c)
        )

    return F.transform(F.array(blocks), lambda block: F.array_join(F.transform(F.split(s, ""), lambda c, i: one(c, i, block)), ""))[0]


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, mod 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + (c.cast("int") >= 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, c: a + c) % 10


def _card(s: Column, digest: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    body = F.concat(F.substring(digits, 1, 1), F.substring(_shape(digits, digest), F.lit(2), F.length(digits) - 2))
    # the last digit that leaves the sum what it was
    last = F.pmod(luhn(digits) - luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return filled(s, F.concat(body, last.cast("string")))


def _ip(digest: Column) -> Column:
    return F.concat_ws(".", *[(_number(digest, 1 + 4 * k, 4) % (223 if k == 0 else 256) + (1 if k == 0 else 0)).cast("string") for k in range(4)])


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a string as hex digits."""
    raw = hashlib.sha256(key.encode()).digest() if len(key.encode()) > 64 else key.encode()
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _email(s: Column, digest: Column, key: str, attempt: int) -> Column:
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    host, last = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.substring_index(domain, ".", -1)
    # of one domain only as many addresses as their forms allow; later attempts leave it
    by_domain = hmac(key, F.concat_ws("|", F.lit("domain"), F.lower(domain), F.lit(str(attempt // 4))))
    return F.concat(_shape(local, digest), F.lit("@"), _shape(host, by_domain), F.lit("."), last)


def _phone(s: Column, digest: Column) -> Column:
    code = F.regexp_extract(s, r"^(\+\d{1,3})?", 0)
    return F.concat(code, _shape(F.substring(s, F.length(code) + 1, F.length(s)), digest))


def _name(s: Column, digest: Column, attempt: int, family: Column, gender: Column) -> Column:
    """A word of a name: of the lists at the first attempt, of two syllables and more at later ones."""
    script = F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def pick(names: str, at: int) -> Column:
        listed = F.split(F.lit(names), " ")
        return F.get(listed, (_number(digest, at, 6) % len(names.split())).cast("int"))

    out = F.lit(None)
    for sc, (onsets, vowels, endings) in SYLLABLES.items():
        for g, ending in endings.items():
            if attempt:
                made = F.initcap(F.concat(*[pick(x, 1 + 6 * k) for k, x in enumerate([onsets, vowels] * (2 + min(attempt // 2, 2)) + [ending])]))
            else:
                made = pick(FAMILY[sc] if g == "s" else GIVEN[sc, g], 1)
            out = F.when((script == sc) & (F.when(family, "s").otherwise(gender) == g), made).otherwise(out)
    return out


def surrogate(kind: Column, s: Column, gender: Column, attempt: int, key: str) -> Column:
    digest = hmac(key, F.concat_ws("|", kind, canonical(kind, s), F.lit(str(attempt))))
    return (
        F.when(kind == "email", _email(s, digest, key, attempt)).when(kind == "ip", _ip(digest)).when(kind == "card", _card(s, digest))
        .when(kind == "phone", _phone(s, digest)).when(kind == "identity", _shape(s, digest)).otherwise(_name(s, digest, attempt, kind == "family", gender))
    )


def assign(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """kind, entity (canonical), surrogate, attempt: one row for each distinct (kind, entity); entities has kind, entity, form, gender."""
    form = F.when(F.col("kind") == "email", F.col("entity")).otherwise(F.min("form"))
    gender = F.when(F.count_if(F.col("gender") == "m") * F.count_if(F.col("gender") == "f") > 0, "n").when(F.count_if(F.col("gender") == "m") > 0, "m").when(F.count_if(F.col("gender") == "f") > 0, "f").otherwise("n")
    known = kept(entities.groupBy("kind", "entity").agg(form.alias("form"), gender.alias("gender")))
    real = known.select(F.col("entity").alias("to")).distinct()
    left, done = known, None
    spread = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(attempts):
        # entities are few bytes but long to work on, so they are spread by number
        tried = kept(left.repartition(spread, "kind", "entity").withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("gender"), k, key))).withColumn("to", canonical(F.col("kind"), F.col("surrogate")))
        # the least entity keeps a surrogate that several would have, unless it is taken or real
        first = tried.groupBy("to").agg(F.min(F.struct("kind", "entity")).alias("e")).select("to", "e.kind", "e.entity")
        free = first.join(real, "to", "left_anti")
        if done is not None:
            free = free.join(done.select(canonical(F.col("kind"), F.col("surrogate")).alias("to")), "to", "left_anti")
        own = kept(tried.join(free, ["to", "kind", "entity"], "left_semi").select("kind", "entity", "surrogate", F.lit(k).alias("attempt")))
        done = own if done is None else done.unionByName(own)
        left = known.join(done, ["kind", "entity"], "left_anti")
        if left.isEmpty():
            return done
    rest = left.withColumn("surrogate", F.concat(surrogate(F.col("kind"), F.col("form"), F.col("gender"), attempts, key), F.lit("~"), F.hex(F.xxhash64("kind", "entity")))).select("kind", "entity", "surrogate", F.lit(attempts).alias("attempt"))
    return done.unionByName(rest)


def _parts(kind: Column, s: Column) -> Column:
    """array<struct<kind, form, gender>>: a name's words, or the entity itself."""
    title = F.regexp_extract(s, _TITLE, 0)
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\.?\x20$"), "f").when(title.rlike(rf"^(?:{MALE})\.?\x20$"), "m").otherwise("n")
    words = F.split(F.substring(s, F.length(title) + 1, F.length(s)), " ")
    named = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "family").otherwise("given").alias("kind"), w.alias("form"), gender.alias("gender")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), s.alias("form"), F.lit("n").alias("gender"))))


def _replaced(text: Column, parts: Column) -> Column:
    """parts: sorted array<struct<start, end, surrogate>>."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    add = lambda acc, c: F.struct(c["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["surrogate"]).alias("out"))
    return F.aggregate(parts, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", attempts: int = ATTEMPTS) -> DataFrame:
    """doc_id, text, parts: array<struct<start, end, kind, surrogate>> in order; text with its entities replaced.

    Only texts that hold an entity are shuffled.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    none = "array<struct<start:int,end:int,kind:string,surrogate:string>>"
    found = rows.withColumn("found", F.when(F.col("text").isNotNull(), mentions(F.col("text"))).otherwise(F.array().cast("array<struct<start:int,end:int,s:string>>")))
    clean = found.filter(F.size("found") == 0).select("doc_id", "text", F.array().cast(none).alias("parts"))
    with_ids = kept(found.filter(F.size("found") > 0).withColumn("text_hash", F.xxhash64("text")))
    each = with_ids.select("doc_id", "text_hash", F.explode("found").alias("m")).distinct()
    each = each.select("doc_id", "text_hash", F.col("m.start").alias("start"), F.col("m.end").alias("end"), _kind(F.col("m.s")).alias("of"), F.col("m.s").alias("s"))
    each = each.select("doc_id", "text_hash", "start", "end", "of", F.when(F.col("of") == "name", F.regexp_extract("s", _TITLE, 0)).otherwise("").alias("title"), F.posexplode(_parts(F.col("of"), F.col("s"))).alias("at", "p"))
    each = each.select("doc_id", "text_hash", "start", "end", "of", "title", "at", "p.*").withColumn("entity", canonical(F.col("kind"), F.col("form")))
    each = kept(each)
    mapped = assign(each.select("kind", "entity", "form", "gender"), key, attempts)
    shouted = (F.col("form") == F.upper("form")) & F.col("form").rlike(r"\p{Lu}")
    in_form = F.when(F.col("kind").isin(*NUMBERS), filled(F.col("form"), F.regexp_replace("surrogate", "[^0-9]", ""))).otherwise(F.col("surrogate"))
    word = F.when(F.col("surrogate").contains("~"), F.col("surrogate")).when(shouted, F.upper("surrogate")).otherwise(in_form).alias("word")
    words = F.array_sort(F.collect_list(F.struct("at", word)))  # the words of one name
    place = ["doc_id", "text_hash", "start", "end", "of", "title"]
    whole = each.join(mapped, ["kind", "entity"]).groupBy(*place).agg(F.concat("title", F.array_join(F.transform(words, lambda w: w["word"]), " ")).alias("surrogate"))
    parts = whole.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("of").alias("kind"), "surrogate"))).alias("parts"))
    a, b = with_ids.alias("a"), parts.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")))
    changed = joined.select("a.doc_id", _replaced(F.col("a.text"), F.col("b.parts")).alias("text"), F.col("b.parts").cast(none).alias("parts"))
    return clean.unionByName(changed)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities, a count for each type, surrogates (kind:start:end:surrogate of the source's places), text_sha256 of the new text."""
    of = lambda kind: F.size(F.filter("parts", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = F.array_join(F.transform("parts", lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"], c["surrogate"])), "\n")
    return pseudonymise(docs, key).select("doc_id", F.size("parts").cast("long").alias("n_entities"), *[of(kind) for kind, _ in TYPES], shown.alias("surrogates"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
