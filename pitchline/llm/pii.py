"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Detected entities are replaced by values of the same kind, shape and script.
Texts are matched once: a person found by title or given name is then known by
each part of the name, so that later mentions by surname are the same person.
Listed names become other listed names of their gender and kind; other names
are respelled by a keyed permutation of their syllables' letters, numbers and
addresses by keyed permutations of their digits.  All of these are one-to-one,
so different entities stay different and equal ones equal in every document; a
check over the distinct entities finds any that meet another's surrogate or
stay as they were, and gives those another turn.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import let, unused
from pitchline.session import cut, discard

# Titles and given names by gender, surnames, name particles, characters of Chinese names.
TITLES = {"m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sir", "Signor", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Signora", "госпожа"), "n": ("Dr", "Prof", "Professor")}
GIVEN = {
    "m": "Adam Alan Albert Alexander Andreas Anton Arthur Ben Bernd Bruno Carl Carlos Charles Christian Daniel David Dennis Diego Edward Emil Eric Felix Frank Franz Fritz Georg George Gerhard Günter Hans Harry Heinrich Henry Hugo Ivan Jack Jacques James Jan Jean Jens Johann John Jonas Jorge Jose Joseph Juan Karl Klaus Kurt Lars Leon Louis Lucas Luigi Luis Lukas Marc Marco Mark Martin Matthias Max Michael Miguel Niels Nicolas Oliver Oscar Otto Pablo Patrick Paul Pedro Peter Philip Pierre Ralf Richard Robert Roger Rolf Samuel Sebastian Stefan Stephen Thomas Tim Tobias Tom Uwe Victor Walter Werner William Wolfgang",
    "f": "Agnes Alice Amelie Amy Andrea Angela Anna Anne Antonia Barbara Beate Berta Birgit Brigitte Camille Carla Carmen Carol Caroline Catherine Charlotte Christine Clara Claudia Diana Dora Doris Edith Elena Eleanor Elisabeth Ella Emily Emma Erika Esther Eva Fiona Frida Gabriele Gertrud Gisela Greta Hannah Heidi Heike Helen Helga Ida Ilse Inge Ingrid Irene Isabel Jane Janet Jennifer Jessica Johanna Joan Julia Julie Karen Karin Katharina Kathrin Laura Lena Linda Lisa Louise Lucia Lucy Margaret Maria Marie Marta Mary Monika Nadia Nancy Nicole Nina Nora Olga Patricia Paula Petra Renate Rosa Ruth Sabine Sandra Sara Sarah Sofia Sophie Susan Susanne Teresa Ursula Vera Victoria",
    "m кириллица": "Алексей Андрей Антон Борис Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Максим Михаил Николай Олег Павел Пётр Сергей Фёдор Юрий",
    "f кириллица": "Александра Алина Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Ксения Людмила Марина Мария Наталья Нина Ольга Светлана Татьяна Юлия",
}
SURNAMES = {
    "latin": "Adams Allen Anderson Baker Bauer Becker Bell Berger Bernard Bianchi Blanc Böhm Brandt Braun Brown Campbell Carter Clark Collins Cook Cooper Davies Davis Diaz Dubois Dupont Edwards Engel Evans Fernandez Ferrari Fischer Fontaine Fournier Frank Friedrich Garcia Garnier Girard Gomez Gonzalez Graf Gray Green Gruber Haas Hahn Hall Harris Hartmann Hernandez Hill Hofer Hoffmann Huber Hughes Jackson Jäger Jensen Johnson Jones Kaiser Keller King Klein Koch Köhler König Kraus Krüger Lambert Lang Lange Larsen Laurent Lefebvre Lehmann Leroy Lewis Lopez Lorenz Ludwig Maier Marino Martinez Mayer Meyer Miller Mitchell Moore Moreau Morel Morgan Moser Müller Murphy Neumann Nielsen Olsen Ortiz Parker Perez Peters Petit Phillips Pohl Ramirez Reed Richter Rivera Roberts Robinson Romano Rossi Roth Roux Ruiz Russo Sanchez Schäfer Schmidt Schmitt Schneider Scholz Schreiber Schröder Schubert Schulz Schuster Schwarz Scott Simon Smith Sommer Stein Stewart Taylor Thompson Torres Turner Vogel Vogt Wagner Walker Ward Watson Weber Weiss Werner White Williams Wilson Winkler Winter Wolf Wood Wright Young Ziegler Zimmermann",
    "кириллица": "Белов Васильев Волков Голубев Егоров Зайцев Иванов Козлов Кузнецов Лебедев Морозов Никитин Новиков Орлов Павлов Петров Попов Семёнов Смирнов Соколов Соловьёв Степанов Фёдоров Яковлев",
    "кириллица f": "Белова Васильева Волкова Голубева Егорова Зайцева Иванова Козлова Кузнецова Лебедева Морозова Никитина Новикова Орлова Павлова Петрова Попова Семёнова Смирнова Соколова Соловьёва Степанова Фёдорова Яковлева",
}
PARTICLES = "von van der den de del della di da dos du la le ter zu bin al".split()
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高梁郑罗宋谢唐韩曹许邓萧冯曾程蔡彭潘袁于董余苏叶吕魏蒋田杜丁沈姜"
HAN_GIVEN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂文辉玲红建华志国梅鹏飞宇浩欣怡佳琳雪晨阳"

_TITLE = "|".join(t for g in TITLES.values() for t in g)
_WORD = r"(?:\p{Lu}['’])?+\p{Lu}\p{Ll}++(?:[-'’]?\p{Lu}\p{Ll}++)*+"
_CAPITALS = r"(?:\p{Lu}['’])?+\p{Lu}{2,}+(?:[-'’]\p{Lu}{2,}+)*+(?!\p{Ll})"
#: A word that may repeat a part of a name that stands elsewhere in the text, in capitals or not.
SHAPE = r"(?<!\p{L})(?:\p{Lu}['’])?+\p{Lu}\p{L}++(?:[-'’]\p{Lu}\p{L}++)*+"
#: What a name follows wherever it is given.
_CUES = ("my name is ", "My name is ", "mein Name ist ", "Mein Name ist ", "ich heiße ", "Ich heiße ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "меня зовут ", "Меня зовут ")


def _any_of(words: list[str]) -> str:
    """An alternation of ``words``, longer ones first, that looks at a first letter once."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items()))


_GIVEN = _any_of([n for names in GIVEN.values() for n in names.split()])
#: Where a title or a name can begin: at a capital, or at the Russian titles' small letter.
_BEGIN = r"(?<!\p{L})(?=[\p{Lu}г])"
_LINKS = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
_NEXT = rf"(?: {_LINKS}(?:{_WORD}|\p{{Lu}}\.(?= \p{{Lu}})))"
_TITLED = rf"{_LINKS}(?:{_WORD}{_NEXT}{{0,2}}|{_CAPITALS}(?: {_CAPITALS}){{0,2}})"
_HAN = r"[\x{4E00}-\x{9FA5}]"
_HONORIFIC = "(?=先生|女士|小姐|太太|教授|博士)"
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)+",
    "person": rf"{_BEGIN}(?:(?:{_TITLE})\.? (?:{_TITLED}|{_HAN}{{2,4}})|(?<={'|'.join(_CUES)})(?:{_WORD}{_NEXT}{{0,2}})|(?:{_GIVEN})(?:-{_WORD})?{_NEXT}{{1,2}}(?!\p{{L}}))|[{HAN_SURNAMES}]{_HAN}{{1,2}}{_HONORIFIC}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?!\.?[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without a match of this have no entity; a cheap test before the patterns.
HINT = rf"@|[0-9][ .-]?[0-9]|[0-9]\.[0-9]|[0-9A-Fa-f]:[:0-9A-Fa-f]|{_BEGIN}(?:(?:{_TITLE})\.? {_LINKS}[\p{{Lu}}\x{{4E00}}-\x{{9FA5}}]|(?<={'|'.join(_CUES)})\p{{Lu}}|(?:{_GIVEN})[ -])|(?=[先女小太教博]){_HONORIFIC}"

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Consonant pairs that are easy to say, and by rule all others: each list is permuted in itself.
_PAIRS = "bl br ch cl cr dr fl fr gl gr kl kn kr ph pl pr sc sh sk sl sm sn sp st sw th tr tw ld ll lm ln lt mb mm mp nd ng nk nn ns nt rb rd rg rk rl rm rn rs rt ss tt ck".split()
_RARE = [a + b for a in _CONSONANTS for b in _CONSONANTS if a + b not in _PAIRS]
_LISTS = [
    list(_VOWELS), list(_CONSONANTS), _PAIRS, _RARE, list("0123456789"), list("äöü"), list("àâéèêëïîôûáíóúñç"), list("аеёиоуыэюя"), list("бвгджзклмнпрстфхцчшщ"),
    list("αεηιουω"), list("βγδζθκλμνξπρστφχψ"), list(HAN_GIVEN), list(HAN_SURNAMES),
]
_UNITS = [u for units in _LISTS for u in units]
_FIRST = [sum(map(len, _LISTS[:k])) for k, units in enumerate(_LISTS) for _ in units]
_COUNT = [len(units) for units in _LISTS for _ in units]
_SEGMENT = rf"[{_CONSONANTS}]{{1,2}}|."
_VOWEL = rf"^[{_VOWELS}äöüàâéèêëïîôûáíóúаеёиоуыэюяαεηιουω]$"
_NAMES = [names.split() for names in (*GIVEN.values(), *SURNAMES.values())]
#: First octets of which no part is private, local or reserved.
_PUBLIC = [n for n in range(1, 224) if n not in (10, 127, 169, 172, 192)]


def _strings(items: list[str]) -> Column:
    return F.split(F.lit(" ".join(items)), " ")


def _ints(items: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, items))), ",").cast("array<int>")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def kind_of(entity: Column) -> Column:
    """The kind of a mention; what matches no other pattern is a person, or a word that may be part of a name."""
    out = F.when(entity.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for k in KINDS[2:]:
        out = out.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), k)
    return out.otherwise("person")


def canonical(kind: Column, entity: Column) -> Column:
    """What two mentions of one entity share: digits only, lower case for mail, names untitled."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    # the groups that a double colon leaves out are zero
    zeros = lambda x: F.array_repeat(F.lit("0"), 8 - F.size(groups(x)))
    full = F.concat(groups(F.substring_index(entity, "::", 1)), F.when(F.contains(entity, F.lit("::")), zeros(entity)).otherwise(F.array().cast("array<string>")), F.when(F.contains(entity, F.lit("::")), groups(F.substring_index(entity, "::", -1))).otherwise(F.array().cast("array<string>")))
    wide = F.lower(F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))
    octets = F.array_join(F.transform(F.split(entity, r"\."), lambda o: o.cast("int").cast("string")), ".")
    name = F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", "")
    return F.when(kind == "email", F.lower(entity)).when(kind == "person", name).when(kind == "iban", F.replace(entity, F.lit(" "))).when(kind == "ip", octets).when(kind == "ipv6", wide).otherwise(digits)


def _turn(stream: Column, unit: Column, i: Column) -> Column:
    """A listed unit moved on within its list by a keyed amount; others stay."""

    def moved(p: Column) -> Column:
        first, n = F.get(_ints(_FIRST), p), F.get(_ints(_COUNT), p)
        by = 1 + F.pmod(_byte(stream, i) * 256 + _byte(stream, i + 13), n - 1)
        return F.when(p < 0, unit).otherwise(F.get(_strings(_UNITS), first + F.pmod(p - first + by, n)))

    return let((F.array_position(_strings(_UNITS), unit) - 1).cast("int"), moved)


def respell(key: Column, word: Column) -> Column:
    """A one-to-one keyed respelling: letter case, length, script and the order of vowels and consonants stay.

    Consonants turn by an amount that the vowels choose, then vowels by one
    that the new consonants choose; whatever is listed moves.
    """

    def step(units: Column, vowels: Column) -> Column:
        moves = lambda x: x.rlike(_VOWEL) == vowels
        stream = F.sha2(F.concat_ws("|", key, F.array_join(F.transform(units, lambda x: F.when(moves(x), "-").otherwise(x)), "")), 256)
        return let(stream, lambda z: F.transform(units, lambda x, i: F.when(moves(x), _turn(z, x, i)).otherwise(x)))

    units = F.regexp_extract_all(F.lower(word), F.lit(_SEGMENT), F.lit(0))
    cased = lambda s: F.array_join(F.zip_with(_chars(word), _chars(s), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b)), "")
    return F.aggregate(F.array(F.lit(False), F.lit(True)), units, step, lambda u: let(F.array_join(u, ""), cased))


def permute(key: Column, digits: Column, base: int = 10) -> Column:
    """A keyed permutation of the digit strings of a length, in base 10 or 16: each half turns by what the other chooses, four times.

    A single digit has no other half and moves by the key alone.
    """
    half = F.floor((F.length(digits) + 1) / 2).cast("int")
    state = F.struct(F.substring(digits, F.lit(1), half).alias("moved"), F.substring(digits, half + 1, F.length(digits)).alias("other"))

    def step(s: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", key, r.cast("string"), s["other"]), 256)
        value = lambda c: c.cast("int") if base == 10 else F.conv(c, base, 10).cast("int")
        told = lambda n: n.cast("string") if base == 10 else F.lower(F.conv(n.cast("string"), 10, base))
        turn = lambda z: F.array_join(F.transform(_chars(s["moved"]), lambda c, i: told(F.pmod(value(c) + _byte(z, i), F.lit(base)))), "")
        return F.struct(s["other"].alias("moved"), let(stream, turn).alias("other"))

    # the halves change places each round; after an even number they are back
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), state, step, lambda s: F.concat(s["moved"], s["other"]))


def _filled(template: Column, values: Column, slot: str) -> Column:
    """``template`` with its characters that match ``slot`` replaced, in order, by those of ``values``."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("s"))

    def step(a: Column, c: Column) -> Column:
        taken = F.struct((a["n"] + 1).alias("n"), F.array_append(a["s"], F.get(_chars(values), a["n"])).alias("s"))
        return F.when(c.rlike(slot), taken).otherwise(F.struct(a["n"].alias("n"), F.array_append(a["s"], c).alias("s")))

    return F.aggregate(_chars(template), start, step, lambda a: F.array_join(a["s"], ""))


def _piece(key: Column, text: Column) -> Column:
    """Letters respelled, by themselves, and digits permuted by themselves: one-to-one."""
    letters = respell(key, F.regexp_replace(text, "[0-9]", "#"))
    return let(F.struct(letters.alias("l"), permute(key, F.regexp_replace(text, "[^0-9]", "")).alias("d")), lambda x: _filled(x["l"], x["d"], "#"))


def _luhn(digits: Column) -> Column:
    """The check digit that follows ``digits``."""
    n = F.length(digits)
    values = F.transform(_chars(digits), lambda c, i: let(c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def _card(entity: Column, middle: Column) -> Column:
    """First digit kept; a check digit that was right stays right, a wrong one wrong by as much."""
    n = F.length(entity)
    off = F.substring(entity, n, F.lit(1)).cast("int") - _luhn(F.substring(entity, F.lit(1), n - 1))
    return let(F.concat(F.substring(entity, 1, 1), middle), lambda x: F.concat(x, F.pmod(_luhn(x) + off, F.lit(10)).cast("string")))


def _iban_check(country: Column, account: Column) -> Column:
    """The check digits of an account number, as a number 2 to 98."""
    add = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + add(c), F.lit(97)))
    return 98 - rest


def _iban(entity: Column, account: Column) -> Column:
    """Country kept; check digits that were right stay right, wrong ones wrong by as much."""
    country, given = F.substring(entity, 1, 2), F.substring(entity, 3, 2).cast("int")
    off = given - _iban_check(country, F.substring(entity, F.lit(5), F.length(entity)))
    # 0 and 1 stand for 97 and 98
    two = lambda c: F.lpad(F.when(c < 2, c + 97).otherwise(c).cast("string"), 2, "0")
    return let(F.pmod(_iban_check(country, account) + off, F.lit(97)), lambda c: F.concat(country, two(c), account))


def _ip(key: Column, address: Column) -> Column:
    """Private, local and reserved addresses stay in their range, public ones public."""
    o = F.split(address, r"\.").cast("array<int>")
    turn = lambda salt, value, n: 1 + F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(salt), value), 256), 1, 7), 16, 10).cast("long"), F.lit(n - 1))

    def within(values: list[int], x: Column, by: Column) -> Column:
        listed = _ints(values)
        return F.get(listed, F.pmod(F.array_position(listed, x) - 1 + by, F.lit(len(values))).cast("int"))

    def new(x: Column) -> Column:
        a, b = F.get(x, 0), F.get(x, 1)
        low = F.get(x, 2) * 256 + F.get(x, 3)
        low = F.pmod(low + turn("low", F.concat_ws(".", a.cast("string"), b.cast("string")), 65536), F.lit(65536))

        def upper(z: Column) -> Column:
            by = turn("second", F.concat_ws(".", a.cast("string"), z.cast("string")), 15)
            keep = {169: 254, 192: 168}
            second = F.when((a == 172) & b.between(16, 31), 16 + F.pmod(b - 16 + by, F.lit(16))).when((a == 172), within([n for n in range(256) if not 16 <= n <= 31], b, by))
            for first, special in keep.items():
                second = second.when((a == first) & (b == special), b).when(a == first, within([n for n in range(256) if n != special], b, by))
            second = second.otherwise(F.pmod(b + by, F.lit(256)))
            first = F.when(F.array_contains(_ints(_PUBLIC), a), within(_PUBLIC, a, turn("first", z.cast("string"), len(_PUBLIC)))).otherwise(a)
            return F.concat_ws(".", first.cast("string"), second.cast("string"), F.floor(z / 256).cast("string"), F.pmod(z, F.lit(256)).cast("string"))

        return let(low.cast("int"), upper)

    return let(o, new)


def _pieces(kind: Column, entity: Column) -> Column:
    """The pieces of a canonical entity that are changed, or kept, each for itself."""
    at, n = F.instr(entity, "@"), F.length(entity)
    top = F.concat(F.lit("."), F.substring_index(entity, ".", -1))
    host = F.substring(entity, at + 1, n - at - F.length(top))
    return (
        F.when(kind == "person", F.regexp_extract_all(entity, F.lit(r"[-'’ ]|[^-'’ ]+"), F.lit(0)))
        .when(kind == "email", F.array(F.substring(entity, F.lit(1), at - 1), F.lit("@"), host, top))
        .when(kind == "iban", F.array(F.substring(entity, F.lit(5), n)))
        .when(kind == "card", F.array(F.substring(entity, F.lit(2), n - 2)))
        .otherwise(F.array(entity))
    )


def surrogate(kind: Column, entity: Column, attempt: Column, secret: str) -> Column:
    """The canonical surrogate of a canonical entity.

    Listed names become another of their list, name particles and initials
    stay, all else is respelled and permuted.
    """
    key = F.concat_ws("|", F.lit(secret), kind, attempt.cast("string"))
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit("names")), 256), 1, 7), 16, 10).cast("long") + attempt

    def one(p: Column, i: Column) -> Column:
        person = kind == "person"
        keep = (person & (p.isin(*PARTICLES, "-", "'", "’", " ") | p.rlike(r"^\p{Lu}\.$"))) | ((kind == "email") & (i % 2 == 1))
        out = F.when(keep, p)
        for names in _NAMES:
            listed = _strings(names)
            out = out.when(person & F.array_contains(listed, p), F.get(listed, F.pmod(F.array_position(listed, p) + F.pmod(number, F.lit(len(names) - 1)), F.lit(len(names))).cast("int")))
        return out.otherwise(_piece(key, p))

    new = F.array_join(F.transform(_pieces(kind, entity), one), "")
    whole = lambda x: F.when(kind == "iban", _iban(entity, F.upper(x))).when(kind == "card", _card(entity, x)).otherwise(x)
    # the first group of a long address, which tells its kind, stays
    wide = F.concat(F.substring(entity, 1, 4), permute(key, F.substring(entity, 5, 28), 16))
    return F.when(kind == "ip", _ip(key, entity)).when(kind == "ipv6", wide).otherwise(let(new, whole))


def render(kind: Column, mention: Column, value: Column) -> Column:
    """``value`` in the format of the mention: its separators, its title, its letter case."""
    title = F.regexp_extract(mention, rf"^(?:{_TITLE})\.? ", 0)
    mail = F.when(mention == F.upper(mention), F.upper(value)).otherwise(value)
    # an account's letters and digits fill its places, the digits of a number only those of digits
    slots = F.when(kind == "iban", F.regexp_replace(mention, "[A-Z0-9]", "#")).otherwise(F.regexp_replace(mention, "[0-9]", "#"))
    named = F.when((F.length(mention) > 1) & (mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(F.concat(title, value))).otherwise(F.concat(title, value))
    wide = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.coalesce(F.nullif(F.ltrim(F.substring(value, i * 4 + 1, F.lit(4)), F.lit("0")), F.lit("")), F.lit("0"))), ":")
    wide = F.when(mention.rlike("[A-F]"), F.upper(wide)).otherwise(wide)
    return F.when(kind == "person", named).when(kind == "ipv6", wide).when(kind == "email", mail).when(kind == "ip", value).otherwise(_filled(slots, value, "#"))


#: A list of known words of this length at most is read through; a longer one is searched by halves.
SHORT = 32


def known_parts(text: Column) -> Column:
    """The parts of the names that a text holds, sorted by their lower case: array<struct<low, part>>."""
    names = F.regexp_extract_all(text, F.lit(PATTERNS["person"]), F.lit(0))
    parts = F.flatten(F.transform(names, lambda m: F.split(F.regexp_replace(m, rf"^(?:{_TITLE})\.? ", ""), "[ ]")))
    parts = F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(*PARTICLES) & ~w.rlike(r"\.$")))
    return F.array_sort(F.transform(parts, lambda w: F.struct(F.lower(w).alias("low"), w.alias("part"))))


def known_form(parts: Column, word: Column) -> Column:
    """The first listed part that ``word`` spells, in whatever case; null for other words."""
    low = F.lower(word)
    near = F.get(F.filter(parts, lambda p: p["low"] == low), 0)["part"]
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    # how many parts order before the word
    before = F.aggregate(steps, F.lit(0), lambda at, by: F.when(by <= F.size(parts) - at, F.when(F.get(parts, at + by - 1)["low"] < low, at + by).otherwise(at)).otherwise(at))
    far = let(before, lambda at: F.when(F.get(parts, at)["low"] == low, F.get(parts, at)["part"]))
    return F.when(F.size(parts) <= SHORT, near).otherwise(far)


_HAN_PART = rf"^{_HAN}"


def _matches(text: Column, parts: Column, take) -> Column:
    """``take(pattern)`` for a text: the patterns alone, or with words of the shape of a name where the text
    holds names.  Chinese names stand between other letters: those a text holds are looked for one by one."""
    han = lambda ps: F.filter(F.transform(ps, lambda p: p["part"]), lambda w: w.rlike(_HAN_PART))
    both = F.concat(F.lit(f"{ANY}|{SHAPE}|(?:"), F.array_join(han(parts), "|"), F.lit(")"))
    return F.when(F.size(parts) == 0, take(F.lit(ANY))).when(F.size(han(parts)) == 0, take(F.lit(f"{ANY}|{SHAPE}"))).otherwise(take(both))


def _mentions(found: Column, parts: Column) -> Column:
    """kind, mention and entity of what was found; without a kind where a word of a name's shape is no part of one."""

    def told(kind: Column, m: Column, entity: Column) -> Column:
        return F.struct(kind.alias("kind"), m.alias("mention"), entity.alias("entity"))

    def one(m: Column) -> Column:
        # a single word, and a name whose honorific is not in the mention, are known by the text's list
        listed = let(known_form(parts, m), lambda name: told(F.when(name.isNotNull(), "person"), m, name))
        return F.when(m.rlike(rf"^(?:{SHAPE}|{_HAN}+)$"), listed).otherwise(let(kind_of(m), lambda k: told(k, m, canonical(k, m))))

    return F.transform(found, one)


def collisions(entities: DataFrame, secret: str) -> DataFrame:
    """``(kind, entity, attempt)`` of the distinct entities that need an attempt above 0; as a rule none.

    An entity that stays as it was, or meets the surrogate of another that
    orders before it, takes its next attempt, until there is none.
    """
    now = cut(entities.withColumn("attempt", F.lit(0)).withColumn("value", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), secret)))
    while True:
        first = now.groupBy("kind", "value").agg(F.min("entity").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        met = now.join(first, ["kind", "value"]).where("entity <> _first").select("kind", "entity")
        bad = cut(met.unionByName(now.where((F.col("value") == F.col("entity")) & F.col("entity").rlike("[\\p{L}0-9]{2}")).select("kind", "entity")).distinct().withColumn("_bad", F.lit(1)))
        if bad.isEmpty():
            discard(bad)
            return now.where("attempt > 0").select("kind", "entity", "attempt")
        after = now.join(bad, ["kind", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("_bad", F.lit(0)))
        again = surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), secret)
        after = cut(after.withColumn("value", F.when(F.col("_bad") == 1, again).otherwise(F.col("value"))).drop("_bad"))
        discard(now)
        discard(bad)
        now = after


def pseudonymize(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced, and ``pii_counts``, a map by kind.

    Columns and rows are kept, but for a column ``pii_counts``; a null text
    stays null; empty and clean texts stay as they are.  Texts are matched once
    and written with what was found; nothing of them is shuffled.  ``secret``
    is the key: who has it can tell which surrogate stands for a guessed entity.
    """
    row, text, known, gaps, found, turns, rid = unused(docs, "_row", "_text", "_known", "_gaps", "_found", "_turns", "_rid")
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col) if len(docs.columns) > 1 else F.lit(0)).alias(row), F.col(text_col).alias(text))
    # null where a cheap test says that there is nothing
    marked = plain.withColumn(known, F.when(F.coalesce(F.col(text), F.lit("")).rlike(HINT), known_parts(F.col(text))))
    some = F.when(F.col(known).isNotNull(), _matches(F.col(text), F.col(known), lambda p: F.regexp_extract_all(F.col(text), p, F.lit(0))))
    marked = marked.withColumn(found, F.when(F.size(some) > 0, some)).withColumn(gaps, F.when(F.col(found).isNotNull(), _matches(F.col(text), F.col(known), lambda p: F.split(F.col(text), p, -1))))
    marked = cut(marked.select(F.monotonically_increasing_id().alias(rid), row, F.when(F.col(found).isNull(), F.col(text)).alias(text), gaps, _mentions(F.col(found), F.col(known)).alias(found)))
    entities = marked.where(F.col(found).isNotNull()).select(F.explode(found).alias("m")).where("m.kind is not null").select("m.kind", "m.entity").distinct()
    redo = collisions(entities, secret)
    if redo.isEmpty():
        rows = marked.withColumn(turns, F.lit(None).cast("map<int,int>"))
    else:
        at = marked.where(F.col(found).isNotNull()).select(rid, F.posexplode(found).alias("at", "m")).join(redo, (F.col("m.kind") == redo["kind"]) & (F.col("m.entity") == redo["entity"]))
        rows = marked.join(at.groupBy(rid).agg(F.map_from_entries(F.collect_list(F.struct("at", "attempt"))).alias(turns)), rid, "left")
    attempt = lambda i: F.coalesce(F.try_element_at(F.col(turns), i), F.lit(0))
    new = F.transform(found, lambda m, i: F.when(m["kind"].isNull(), m["mention"]).otherwise(render(m["kind"], m["mention"], surrogate(m["kind"], m["entity"], attempt(i), secret))))
    joined = let(new, lambda n: F.array_join(F.transform(gaps, lambda x, i: F.concat(x, F.coalesce(F.get(n, i), F.lit("")))), ""))
    count = lambda k: F.coalesce(F.size(F.filter(found, lambda m: m["kind"] == k)), F.lit(0))
    counts = F.map_from_arrays(F.array(*(F.lit(k) for k in KINDS)), F.array(*(count(k) for k in KINDS)))
    out = F.when(F.col(found).isNull(), F.col(text)).otherwise(joined)
    whole = [out.alias(c) if c == text_col else F.col(row)[c].alias(c) for c in docs.columns if c != "pii_counts"]
    return rows.select(*whole, counts.alias("pii_counts"))
