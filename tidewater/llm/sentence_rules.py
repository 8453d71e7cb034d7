"""Segmentation rule tables: ordered break and no-break pairs, a table per language.

A rule is (break?, pattern before the position, pattern after it). The cascade
of a block is: rules of every block, the table for blocks without capitals if
it has none, the tables of its languages, the default table. The first rule
that matches a position decides it.

Which languages a block is in follows from its scripts and, in Latin script,
from the function words in it (see ``sentences.languages``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

BREAK, KEEP = True, False

Rule = tuple[bool, str, str]


@dataclass(frozen=True)
class Language:
    """What a table is made of."""

    script: str
    #: words that show that Latin text is in this language
    function_words: tuple[str, ...] = ()
    #: abbreviations never at the end of a sentence: titles and joining ones
    joining: tuple[str, ...] = ()
    #: abbreviations not at the end where a number follows
    numbered: tuple[str, ...] = ()
    #: abbreviations at the end only where a capital follows: units, list ends
    tail: tuple[str, ...] = ()
    #: sounds that open a sentence, trail off and go on
    hesitation: tuple[str, ...] = ()
    #: conjunctions, prepositions and verbs of saying: after a quotation or
    #: bracket they carry the sentence on
    going_on: tuple[str, ...] = ()
    #: verbs and conjunctions: after "etc." they carry the sentence on
    after_list: tuple[str, ...] = ()
    #: rules of its own, before the others
    rules: tuple[Rule, ...] = field(default=())


MONTHS_DE = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")

#: Sentence terminals of Unicode, and the Tibetan shad, which it doesn't count.
TERMINAL = r"[\p{SB=STerm}།༎]"
_END = rf"(?:[.!?…]|{TERMINAL})"
_CLOSE = r"[\"”'’“»)\]」』】》〉）]"
_EDGE = r"(?<![\p{L}\p{M}\p{N}.])"


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


#: The word lists.
LANGUAGES = {
    "en": Language(
        r"\p{Latin}",
        function_words=("the", "of", "and", "is", "to", "my", "it", "i", "you", "this", "that", "for", "with", "on", "was", "are", "have", "does", "how"),
        joining=("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Capt", "Gen", "Lt", "vs", "approx", r"e\.\s?g", r"i\.\s?e", "cf", "incl"),
        numbered=("No", "Nos", "Fig", "Figs", "p", "pp", "Vol", "Ch", "Sec", "Eq", "Art", "v", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"),
        tail=("etc", "min", "sec", "hr", "hrs", "Co", "Inc", "Ltd", "Jr", "ft", "in", r"a\.m", r"p\.m", r"U\.S", "dept", "est"),
        hesitation=("well", "h+m+", "u+[hm]+", "so", "er+m?"),
        going_on=("he", "she", "they", "we", "i said", "says", "and", "or", "but", "then", "on", "in", "at", "to", "of", "for", "with", "when", "while", "before", "after", "as", "is", "was", "said", "asked"),
        after_list=("did", "do", "does", "is", "are", "was", "were", "have", "has", "will", "can", "and", "or", "but"),
    ),
    "de": Language(
        r"\p{Latin}",
        function_words=("der", "die", "das", "und", "ist", "ich", "mein", "nicht", "den", "mit", "ein", "es", "auf", "wir", "wie", "aber", "denn"),
        joining=("Dr", "Prof", "Hr", "Fr", r"z\.\s?B", r"d\.\s?h", r"u\.\s?a", r"o\.\s?ä", "bzw", "bspw", "ca", "inkl", "zzgl", "evtl", "ggf", "vgl"),
        numbered=("Nr", "S", "Abb", "Kap", "Bd", "Tab", "Art", "Abs"),
        tail=("usw", "Std", "Min", "Sek", "Mio", "Mrd", "Str"),
        hesitation=("na ja", "tja", "also", "äh+m?", "h+m+"),
        going_on=("er sagt", "und", "oder", "aber", "auf", "dann", "sagte", "fragte"),
        after_list=("haben", "hat", "sind", "ist", "und", "oder"),
        rules=((KEEP, r"(?<![\p{L}\p{N}.,])\d{1,2}\.", rf"\s+(?i:{_any(MONTHS_DE)})\b"),),
    ),
    "fr": Language(
        r"\p{Latin}",
        function_words=("le", "la", "les", "et", "mon", "est", "je", "des", "ne", "pas", "un", "une", "il", "du", "mais", "j'ai", "car", "sans"),
        joining=("M", "MM", "Mme", "Mlle", "Dr", "Pr", "env", "cf", r"p\.\s?ex", r"c\.-à-d"),
        numbered=("p", "pp", "fig", "chap", "vol", "art", "n"),
        tail=("etc", "min", "sec", "h", "av"),
        hesitation=("e+uh", "bon", "ben", "h+m+"),
        going_on=("a dit", "et", "ou", "mais", "puis", "dit"),
        after_list=("n'ont", "ont", "ne", "sont", "et"),
    ),
    "es": Language(
        r"\p{Latin}",
        function_words=("el", "los", "y", "es", "mi", "con", "para", "lo", "las", "que", "en", "se", "pero", "porque", "quedan", "cambié"),
        joining=("Sr", "Sra", "Srta", "Dr", "Dra", "Ud", "Uds", "aprox", r"p\.\s?ej", "cf"),
        numbered=(r"n\.\s?º", "núm", "pág", "págs", "fig", "cap", "art", "vol"),
        tail=("etc", "min", "seg", "h", r"EE\.\s?UU"),
        hesitation=("bueno", "pues", "este", "h+m+"),
        going_on=("y", "e", "o", "pero", "luego", "en", "dijo", "preguntó"),
        after_list=("no", "han", "son", "y"),
        rules=((KEEP, r"(?i:(?<!\p{L})n\.)", r"\s?º"),),
    ),
    "ru": Language(
        r"\p{Cyrillic}",
        joining=("г", "гг", "д-р", "проф", "ок", r"т\.\s?е", r"т\.\s?к", r"т\.\s?н", "напр", "см", "им"),
        numbered=("рис", "стр", "гл", "табл", "п", "ст", "с", "т"),
        tail=("мин", "сек", "град", "тыс", "млн", "руб", "др", r"т\.\s?д", r"т\.\s?п", "ч", "кг"),
        hesitation=("ну", "хм+", "э+"),
        going_on=("и", "а", "но", "или", "затем", "сказал", "спросил"),
        after_list=("не", "и"),
    ),
    "el": Language(
        r"\p{Greek}",
        joining=("κ", "κα", "κκ", "Δρ", "καθ", "περ", r"π\.\s?χ", "δηλ", "βλ"),
        numbered=("σελ", "αρ", "εικ", "κεφ", "σχ"),
        tail=(r"κ\.\s?λπ", r"κ\.\s?ά", "κλπ", "λεπ", "δευτ"),
        hesitation=("λοιπόν", "χμ+"),
        going_on=("και", "αλλά", "ή", "μετά"),
        rules=((BREAK, r"\p{Greek}[`\p{M}]*;", r"\s"),),
    ),
    "ar": Language(r"\p{Arabic}", joining=("د", "أ", "م"), numbered=("ص", "رقم"), hesitation=("حسنا", "حسنًا", "طيب", "خب"), going_on=("ثم", "و", "أو", "لكن", "قال")),
    "hi": Language(r"\p{Devanagari}", joining=("डॉ", "श्री", "प्रो", "कु", "पं"), numbered=("सं", "पृ", "चित्र"), hesitation=("हम्म", "अच्छा", "खैर"), going_on=("और", "या", "फिर", "लेकिन", "तो", "कहा")),
    "zh": Language(r"\p{Han}", hesitation=("嗯+", "呃+"), rules=((KEEP, rf"[。！？｡．]{_CLOSE}+", r"\s*(?:然后|就|而|并|的)"),)),
    "ja": Language(r"[\p{Hiragana}\p{Katakana}]", hesitation=("えっと", "ええと", "あの", "うーん"), rules=((KEEP, rf"[。！？｡．]{_CLOSE}+", r"\s*[とってにでがはをもなのか]"),)),
    "ko": Language(r"\p{Hangul}", hesitation=("음+", "글쎄", "저기"), rules=((KEEP, rf"{_END}{_CLOSE}+", r"\s*(?:이?라고|하고|이?라는|고|라며)(?!\p{Hangul}*[.!?])"),)),
    "th": Language(r"\p{Thai}", hesitation=("อืม+",), going_on=("แล้ว", "แล้วก็", "และ", "แต่"), rules=((BREAK, r"(?:ครับ|ค่ะ|คะ|จ้ะ|จ้า|[๚๛])", r"\s"),)),
}

#: Rules of every block.
FIRST: list[Rule] = [
    (KEEP, r"", r"\s*[,;:，；：、]"),
    (KEEP, r"", r"\s+(?:[\p{Emoji_Presentation}☀-➿]|(?:\^\^|[:;]-?[)(DP])(?:\s|$))"),
    (KEEP, r"(?:^|[\s(])\p{Lu}\.", r"\s+\p{Lu}"),
]

DEFAULT: list[Rule] = [
    (KEEP, r"(?:\.\.\.|…)", r"\s+\p{Ll}"),
    (BREAK, rf"[。！？｡．]{_CLOSE}*", r""),
    (BREAK, rf"(?![.!?…]){TERMINAL}{_CLOSE}*", r""),
    (BREAK, rf"[.!?…](?:[\s ]?{_CLOSE})*", r"\s"),
    # the space after the end mark was forgotten
    (BREAK, r"(?<![\p{L}\p{N}_.])\p{Ll}{2,}[.!?…]", r"\p{Lu}\p{Ll}*(?:[\s',]|$)"),
    (BREAK, r"(?:[\p{Emoji_Presentation}️]|\^\^|[:;]-?[)(DP])", r"\s+\p{Lu}"),
    (KEEP, r"", r""),
]


def small(codes: tuple[str, ...]) -> list[Rule]:
    """Rules of blocks without capitals, where a small letter says nothing."""
    going, after = ([w for c in codes for w in getattr(LANGUAGES[c], kind)] for kind in ("going_on", "after_list"))
    out = [(KEEP, rf"(?:^|[\s(])\p{{Ll}}\.", r"\s+\p{Ll}\.\s"), (KEEP, rf"(?:^|[\s(])\p{{Ll}}\.\s\p{{Ll}}\.", r"\s+\p{Ll}{2}")]
    if after:
        out.append((BREAK, rf"{_EDGE}{_any(['etc', 'usw'])}\.", rf"\s+(?!{_any(after)}\b)\p{{L}}"))
    if going:
        out.append((KEEP, r"(?:\.\.\.|…)", rf"\s+{_any(going)}(?!\p{{L}})"))
    return [*out, (BREAK, r"(?:\.\.\.|…)", r"\s+\p{Ll}")]


def table(code: str) -> list[Rule]:
    """The table of one language."""
    t = LANGUAGES[code]
    rules = list(t.rules)
    if t.joining:
        rules.append((KEEP, rf"(?i:{_EDGE}{_any(t.joining)})\.", r"\s"))
    if t.numbered:
        rules.append((KEEP, rf"(?i:{_EDGE}{_any(t.numbered)})\.?", r"\s+[#№]?\p{N}"))
    if t.tail:
        rules.append((KEEP, rf"(?i:{_EDGE}{_any(t.tail)})\.", r"\s+[\p{Ll}\p{N}(]"))
    for word in [*t.joining, *t.numbered, *t.tail]:
        first, _, rest = word.partition(r"\.\s?")
        if rest:  # between the parts of an abbreviation
            rules.append((KEEP, rf"(?i:{_EDGE}{first})\.", rf"\s+(?i:{rest})(?:\.|(?!\p{{L}}))"))
    return rules


def cascade(codes: tuple[str, ...], without_capitals: bool) -> list[Rule]:
    """Rules for a block in the languages ``codes``, in order."""
    hesitation = [w for c in codes for w in LANGUAGES[c].hesitation]
    rules = FIRST[:2]
    if hesitation:
        rules = [*rules, (KEEP, rf"(?i:(?<!\p{{L}}){_any(dict.fromkeys(hesitation))})\s?(?:\.{{2,}}|…+)", r"\s*")]
    rules = [*rules, *FIRST[2:], *(small(codes) if without_capitals else [])]
    for c in codes:
        rules += table(c)
    going = [w for c in codes for w in LANGUAGES[c].going_on]
    quoted = [(KEEP, rf"{_END}\s?{_CLOSE}+", rf"\s+{_any(going)}(?![\p{{L}}\p{{M}}])")] if going else []
    return [*rules, DEFAULT[0], *quoted, *DEFAULT[1:]]
