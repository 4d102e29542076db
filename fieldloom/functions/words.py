"""Numbers in words: cardinals, ordinals and amounts in twelve languages.

A language gives the words below a hundred, its hundreds and its thousands; numbers are put together from these. As
columns, words are two look-ups in tables made when the plan is built: the thousands, and the rest with or without any.
Numbers above 32,767 stay digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from fieldloom.functions.culture import EN, Culture
from fieldloom.functions.values import let

MOST = 32_767


def _words(text: str) -> list[str]:
    return text.split()


# Number words of the languages.
EN_SMALL = _words("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen")
EN_TENS = _words("twenty thirty forty fifty sixty seventy eighty ninety")
EN_ORDINAL = _words("zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth")
EN_ORDINAL_TENS = _words("twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth")
FR_SMALL = _words("zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf")
FR_TENS = _words("vingt trente quarante cinquante soixante")
DE_SMALL = _words("null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn")
DE_TENS = _words("zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig")
DE_ORDINAL = {1: "erste", 2: "zweite", 3: "dritte", 7: "siebte", 8: "achte"}
ES_SMALL = _words("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve")
ES_TWENTIES = _words("veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve")
ES_TENS = _words("treinta cuarenta cincuenta sesenta setenta ochenta noventa")
ES_ORDINAL = _words("cero primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo")
IT_SMALL = _words("zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove")
IT_TENS = _words("venti trenta quaranta cinquanta sessanta settanta ottanta novanta")
IT_ORDINAL = _words("zero primo secondo terzo quarto quinto sesto settimo ottavo nono decimo")
PT_SMALL = _words("zero um dois três quatro cinco seis sete oito nove dez onze doze treze catorze quinze dezesseis dezessete dezoito dezenove")
PT_TENS = _words("vinte trinta quarenta cinquenta sessenta setenta oitenta noventa")
PT_HUNDREDS = _words("cento duzentos trezentos quatrocentos quinhentos seiscentos setecentos oitocentos novecentos")
PT_ORDINAL = _words("zero primeiro segundo terceiro quarto quinto sexto sétimo oitavo nono décimo")
DA_SMALL = _words("nul en to tre fire fem seks syv otte ni ti elleve tolv tretten fjorten femten seksten sytten atten nitten")
DA_TENS = _words("tyve tredive fyrre halvtreds tres halvfjerds firs halvfems")
DA_ORDINAL = _words("nulte første anden tredje fjerde femte sjette syvende ottende niende tiende")
FI_SMALL = _words("nolla yksi kaksi kolme neljä viisi kuusi seitsemän kahdeksan yhdeksän kymmenen yksitoista kaksitoista kolmetoista neljätoista viisitoista kuusitoista seitsemäntoista kahdeksantoista yhdeksäntoista")
FI_ORDINAL = _words("nollas ensimmäinen toinen kolmas neljäs viides kuudes seitsemäs kahdeksas yhdeksäs kymmenes yhdestoista kahdestoista kolmastoista neljästoista viidestoista kuudestoista seitsemästoista kahdeksastoista yhdeksästoista")
FI_ORDINAL_STEMS = _words("kahdes kolmas neljäs viides kuudes seitsemäs kahdeksas yhdeksäs")
EL_SMALL = _words("μηδέν ένα δύο τρία τέσσερα πέντε έξι επτά οκτώ εννέα δέκα έντεκα δώδεκα δεκατρία δεκατέσσερα δεκαπέντε δεκαέξι δεκαεπτά δεκαοκτώ δεκαεννέα")
EL_TENS = _words("είκοσι τριάντα σαράντα πενήντα εξήντα εβδομήντα ογδόντα ενενήντα")
EL_HUNDREDS = _words("εκατό διακόσια τριακόσια τετρακόσια πεντακόσια εξακόσια επτακόσια οκτακόσια εννιακόσια")
EL_ORDINAL = _words("μηδενικός πρώτος δεύτερος τρίτος τέταρτος πέμπτος έκτος έβδομος όγδοος ένατος δέκατος ενδέκατος δωδέκατος")
EL_ORDINAL_TENS = _words("εικοστός τριακοστός τεσσαρακοστός πεντηκοστός εξηκοστός εβδομηκοστός ογδοηκοστός ενενηκοστός")
EL_ORDINAL_HUNDREDS = _words("εκατοστός διακοσιοστός τριακοσιοστός τετρακοσιοστός πεντακοσιοστός εξακοσιοστός επτακοσιοστός οκτακοσιοστός εννιακοσιοστός")
JA_DIGITS, ZH_DIGITS = "〇一二三四五六七八九", "零一二三四五六七八九"
TH_DIGITS = _words("ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า")
TH_UNITS = ["", *_words("สิบ ร้อย พัน หมื่น")]


@dataclass(frozen=True)
class Language:
    """``cardinal`` and ``ordinal`` take 0 to 32,767. ``base`` is where the tables of the columns split a number."""

    cardinal: Callable[[int], str]
    ordinal: Callable[[int], str]
    minus: str
    and_: str
    base: int = 1000
    #: What a negative ordinal starts with, and whether the cardinal follows it.
    minus_ordinal: tuple[str, bool] | None = None


@dataclass(frozen=True)
class Places:
    """Words below a hundred, of hundreds (by digit; alone, and before a rest) and of thousands."""

    below: list[str]
    hundred: Callable[[int, bool], str]
    thousand: Callable[[int, str], str]
    gap: str = " "
    gap_hundred: str | None = None
    #: The hundreds between a thousand and a rest below a hundred.
    none_after_thousand: str = ""
    memo: dict[int, str] = field(default_factory=dict)

    def __call__(self, n: int, last: Places | None = None) -> str:
        """``last`` has the words of the last place that isn't zero, as ordinals want."""
        end = last or self
        t, rest = divmod(n, 1000)
        h, low = divmod(rest, 100)
        out = []
        if t:
            out.append((end if not rest else self).thousand(t, self(t)) + (self.gap if rest else ""))
        if h:
            gap = self.gap if self.gap_hundred is None else self.gap_hundred
            out.append((end if not low else self).hundred(h, bool(low)) + (gap if low else ""))
        elif t and low:
            out.append(self.none_after_thousand)
        if low or not n:
            out.append(end.below[low])
        return "".join(out)


def _below(small: list[str], tens: list[str], join: Callable[[str, str, int], str]) -> list[str]:
    """Words from 0 to 99: ``join`` puts the words of a ten and a one together, by the one's digit."""
    return small + [w if not i else join(w, small[i], i) for w in tens for i in range(10)]


def _from_list(first: list[str], rest: Callable[[int], str]) -> Callable[[int], str]:
    return lambda n: first[n] if n < len(first) else rest(n)


_en = Places(_below(EN_SMALL, EN_TENS, lambda t, o, _: f"{t}-{o}"), lambda h, _: f"{EN_SMALL[h]} hundred", lambda _, w: f"{w} thousand")
_en_last = Places(EN_ORDINAL + [o if not i else f"{w}-{EN_ORDINAL[i]}" for w, o in zip(EN_TENS, EN_ORDINAL_TENS, strict=True) for i in range(10)], lambda h, _: f"{EN_SMALL[h]} hundredth", lambda _, w: f"{w} thousandth")

_fr_60 = _below(FR_SMALL, FR_TENS, lambda t, o, i: f"{t} et un" if i == 1 else f"{t}-{o}")
_fr = Places([*_fr_60, *(f"soixante-{w}" for w in FR_SMALL[10:]), "quatre-vingts", *(f"quatre-vingt-{w}" for w in FR_SMALL[1:])], lambda h, rest: ("" if h == 1 else FR_SMALL[h] + " ") + ("cent" if rest or h == 1 else "cents"), lambda t, w: "mille" if t == 1 else f"{w} mille")


def _fr_ordinal(n: int) -> str:
    word = _fr(n)
    if n == 1:
        return "premier"
    if word.endswith("cinq"):
        return word + "uième"
    return (word[:-1] + "v" if word.endswith("neuf") else word.removesuffix("e") if n else word) + "ième"


_de = Places(_below(DE_SMALL, DE_TENS, lambda t, o, i: ("ein" if i == 1 else o) + "und" + t), lambda h, _: ("ein" if h == 1 else DE_SMALL[h]) + "hundert", lambda t, w: ("" if t == 1 else w) + "tausend", "", none_after_thousand="nullhundert")
_es = Places(ES_SMALL + ES_TWENTIES + _below(ES_SMALL, ES_TENS, lambda t, o, _: f"{t} y {o}")[20:], lambda h, rest: {1: "ciento" if rest else "cien", 5: "quinientos", 7: "setecientos", 9: "novecientos"}.get(h, ES_SMALL[h] + "cientos"), lambda t, w: "mil" if t == 1 else f"{w} mil")
_it = Places(_below(IT_SMALL, IT_TENS, lambda t, o, i: (t[:-1] if i in (1, 8) else t) + o), lambda h, _: ("" if h == 1 else IT_SMALL[h]) + "cento", lambda t, w: "mille" if t == 1 else f"{w}mila", "")
_pt = Places(_below(PT_SMALL, PT_TENS, lambda t, o, _: f"{t} e {o}"), lambda h, rest: "cem" if h == 1 and not rest else PT_HUNDREDS[h - 1], lambda t, w: "mil" if t == 1 else f"{w} mil", gap_hundred=" e ")
_da = Places(_below(DA_SMALL, DA_TENS, lambda t, o, _: f"{o}og{t}"), lambda h, _: ("" if h == 1 else DA_SMALL[h]) + "hundrede", lambda t, w: ("" if t == 1 else w) + "tusind", "")
_fi = Places(_below(FI_SMALL, [w + "kymmentä" for w in FI_SMALL[2:10]], lambda t, o, _: t + o), lambda h, _: "sata" if h == 1 else FI_SMALL[h] + "sataa", lambda t, w: "tuhat" if t == 1 else f"{w}tuhatta", "")
_fi_all = Places(_below(FI_ORDINAL, [w + "kymmenes" for w in FI_ORDINAL_STEMS], lambda t, o, _: t + o), lambda h, _: "sadas" if h == 1 else FI_ORDINAL_STEMS[h - 2] + "sadas", lambda t, _: ("" if t == 1 else _fi(t)) + "tuhannes", "")
_el = Places(_below(EL_SMALL, EL_TENS, lambda t, o, _: f"{t} {o}"), lambda h, rest: "εκατόν" if h == 1 and rest else EL_HUNDREDS[h - 1], lambda t, w: "χίλια" if t == 1 else f"{w} χιλιάδες")
_el_teens = [f"δέκατος {w}" for w in EL_ORDINAL[3:10]]
_el_last = Places(_below(EL_ORDINAL + _el_teens, EL_ORDINAL_TENS, lambda t, o, _: f"{t} {o}"), lambda h, _: EL_ORDINAL_HUNDREDS[h - 1], lambda t, w: "χιλιοστός" if t == 1 else f"{w} χιλιοστός")


def _ja(n: int) -> str:
    """Digits before 十 百 千 万, a one left out."""
    if n >= 10_000:
        return ("" if n < 20_000 else _ja(n // 10_000)) + "万" + (_ja(n % 10_000) if n % 10_000 else "")
    out = "".join(("" if d == "1" and unit else JA_DIGITS[int(d)]) + unit for d, unit in zip(f"{n:04d}", ("千", "百", "十", ""), strict=True) if d != "0")
    return out or JA_DIGITS[0]


def _zh(n: int) -> str:
    """Digits before 十 百 千 万; places left out inside are one 零, and ten by itself has no one."""
    if n >= 10_000:
        rest = n % 10_000
        return _zh(n // 10_000) + "万" + ("零" if 0 < rest < 1000 else "") + (_zh(rest) if rest else "")
    if n < 20:
        return ZH_DIGITS[n] if n < 10 else "十" + (ZH_DIGITS[n - 10] if n > 10 else "")
    t, h, d, o = map(int, f"{n:04d}")
    out = f"{ZH_DIGITS[t]}千" if t else ""
    out += f"{ZH_DIGITS[h]}百" if h else "零" if t and (d or o) else ""
    out += f"{ZH_DIGITS[d]}十" if d else "零" if o and (h or t) else ""
    return out + (ZH_DIGITS[o] if o else "")


def _th(n: int) -> str:
    places = [(int(d), p) for p, d in zip(range(len(str(n)) - 1, -1, -1), str(n), strict=True)]

    def place(d: int, p: int) -> str:
        if p == 1:
            return {1: "", 2: "ยี่"}.get(d, TH_DIGITS[d]) + TH_UNITS[1]
        return "เอ็ด" if p == 0 and d == 1 and n > 10 else TH_DIGITS[d] + TH_UNITS[p]

    return "".join(place(d, p) for d, p in places if d) or TH_DIGITS[0]


def _it_ordinal(n: int) -> str:
    return _it(n).removesuffix("e").removesuffix("a") + "esimo"


LANGUAGES: dict[str, Language] = {
    "en": Language(_en, lambda n: _en(n, _en_last), "minus ", " and "),
    "fr": Language(_fr, _fr_ordinal, "moins ", " et "),
    "de": Language(_de, lambda n: "nullte" if not n else DE_ORDINAL.get(n) or _de(n) + ("te" if n < 20 else "ste"), "minus ", " und "),
    "es": Language(_es, _from_list(ES_ORDINAL, lambda n: _es(n) + "avo"), "menos ", " y "),
    "it": Language(_it, _from_list(IT_ORDINAL, _it_ordinal), "meno ", " e "),
    "pt": Language(_pt, _from_list(PT_ORDINAL, lambda n: _pt(n) + "º"), "menos ", " e "),
    "da": Language(_da, _from_list(DA_ORDINAL, lambda n: _da(n) + "ende"), "minus ", " og "),
    "fi": Language(_fi, _fi_all, "miinus ", " ja "),
    "el": Language(_el, lambda n: _el(n, _el_last), "μείον ", " και "),
    "ja": Language(_ja, lambda n: "第" + _ja(n), "マイナス ", " と ", minus_ordinal=("第マイナス ", True)),
    "th": Language(_th, lambda n: "ที่" + _th(n), "ลบ ", " และ ", minus_ordinal=("ที่ลบ ", True)),
    "zh": Language(_zh, lambda n: "第" + _zh(n), "负", "和", 10_000, minus_ordinal=("第负", True)),
}


def language(name: str | Culture | None, extra: dict[str, Language] | None = None) -> Language:
    """By exact name, then by language, else English; ``extra`` ones come first."""
    known = LANGUAGES | (extra or {})
    full = name.name if isinstance(name, Culture) else name or EN.name
    return known.get(full) or known.get(full.split("-")[0].lower()) or known["en"]


def _table(items: list[str]) -> Column:
    return F.split(F.lit("|".join(items)), r"\|")  # one literal, folded to an array


def _spoken(n: Column, say: Callable[[int], str], base: int) -> Column:
    """The words of 0 to MOST: those of the whole number where it is below the base or a multiple of it, else the words
    of the multiple, as they start a longer number, and of the rest."""
    heads = [say(i * base) for i in range(MOST // base + 1)]
    starts = [_common(say((i or 1) * base + 1), say((i or 1) * base + 2), say((i or 1) * base + base // 2)) for i in range(MOST // base + 1)]
    rests = ["", *(say(base + r)[len(starts[1]) :] for r in range(1, base))]
    t, r = F.floor(n / base).cast("int"), (n % base).cast("int")
    pick = lambda items, i: F.get(_table(items), i)
    return F.when(n < base, pick([say(i) for i in range(base)], r)).when(r == 0, pick(heads, t)).otherwise(F.concat(pick(starts, t), pick(rests, r)))


def _common(*texts: str) -> str:
    n = 0
    while len({t[: n + 1] for t in texts}) == 1 and n < min(map(len, texts)):
        n += 1
    return texts[0][:n]


def _size(whole: Column) -> Column:
    return F.least(F.abs(whole), F.lit(MOST).cast("long"))


def cardinal(x: Column, lang: Language | str | Culture | None = None) -> Column:
    """Rounded half to even."""
    lang = lang if isinstance(lang, Language) else language(lang)
    return let(F.bround(x.cast("double")).cast("long"), lambda whole: _cardinal(whole, lang))


def _cardinal(whole: Column, lang: Language) -> Column:
    words = _spoken(_size(whole), lang.cardinal, lang.base)
    # A negative number above the limit is the sign's word and the digits.
    spoken = F.when(F.abs(whole) > MOST, F.abs(whole).cast("string")).otherwise(words)
    return F.when(whole < 0, F.concat(F.lit(lang.minus), spoken)).otherwise(spoken)


def ordinal(x: Column, lang: Language | str | Culture | None = None) -> Column:
    lang = lang if isinstance(lang, Language) else language(lang)
    return let(F.bround(x.cast("double")).cast("long"), lambda whole: _ordinal(whole, lang))


def _ordinal(whole: Column, lang: Language) -> Column:
    size = _size(whole)
    prefix, plain = lang.minus_ordinal or (lang.minus, False)
    digits = F.abs(whole).cast("string")
    words = F.when(F.abs(whole) > MOST, digits).otherwise(_spoken(size, lang.ordinal, lang.base))
    below = F.when(F.abs(whole) > MOST, digits).otherwise(_spoken(size, lang.cardinal, lang.base)) if plain else words
    return F.when(whole < 0, F.concat(F.lit(prefix), below)).otherwise(words)


def dollars(x: Column, lang: Language | str | Culture | None = None) -> Column:
    """Words of the whole amount, then the cents as hundredths, rounded half up."""
    lang = lang if isinstance(lang, Language) else language(lang)
    size = F.abs(x.cast("double"))
    cents = F.floor((size - F.floor(size)) * 100 + 0.5)
    whole = F.floor(size) + F.floor(cents / 100)
    out = F.concat(cardinal(whole, lang), F.lit(lang.and_), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("/100"))
    return F.when(x < 0, F.concat(F.lit(lang.minus), out)).otherwise(out)
