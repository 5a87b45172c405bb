"""The language of short texts by their function words."""

from __future__ import annotations

import re
from collections import Counter

# Frequent function words that the other three languages do not use.
FUNCTION = {
    "en": "the and was were that this with from which have has had not you they their there been would could about when what who why how because although until by it its an of to for are is at every did does while before after some into",
    "de": "der die das und nicht mit von den dem ein eine einen einer einem ist war wurde auf für sich auch nach bei aus wie wer wann warum weil obwohl während dass zum zur hat haben sie wir ihr im beim oder aber alle danach wurden vom um",
    "fr": "le les des du et une est dans pour pas que qui sur avec au aux ce cette ces été son ses leur il elle nous vous mais ou où par plus comme quand pourquoi après avant sans depuis jusqu pendant lors puis parce ont était a-t-il l d qu n",
    "es": "el los las y una es en por para con no del al lo como más pero sus ha fue este esta entre cuando quién qué cómo cuándo porque aunque hasta sobre sin desde según también durante después mientras cuántos dijo había son ya luego su se",
}
WORD_LANGUAGES: dict[str, str] = {}
_seen = Counter(w for words in FUNCTION.values() for w in words.split())
for _lang, _words in FUNCTION.items():
    for _w in _words.split():
        if _seen[_w] == 1:
            WORD_LANGUAGES[_w] = _lang
KANA = re.compile(r"[぀-ヿ]")
TOKEN = re.compile(r"[^\W\d_]+")
QUOTED = re.compile(r"[“\"„«»‟][^“”\"«»„]{3,}[”\"»“«]")
#: How a question asks for a language, by the language asked for.
ASKED = {
    "en": r"english|englisch|anglais|inglés|ingles|英語",
    "de": r"german|deutsch|allemand|alemán|aleman|ドイツ語",
    "fr": r"french|französisch|français|francais|francés|frances|フランス語",
    "es": r"spanish|spanisch|espagnol|español|espanol|スペイン語",
    "ja": r"japanese|japanisch|japonais|japonés|日本語",
}
VERBS = r"answer|reply|respond|write|say|explain|translate|antwort\w*|beantwort\w*|schreib\w*|erklär\w*|répond\w*|écri\w*|expliqu\w*|tradui\w*|respond\w*|contest\w*|escrib\w*|explic\w*|traduc\w*|übersetz\w*|答え|回答"
PREPOSITIONS = r"in|into|auf|en|ins|al|"
REQUEST = {lang: re.compile(rf"(?:{VERBS})\W[^.?!¿]{{0,40}}?\b(?:{names})|\b(?:auf|in|en)\s+(?:{names})\s+(?:{VERBS})", re.I) for lang, names in ASKED.items()}


def language(text: str | None, margin: float = 1.5, least: float = 1) -> str | None:
    """en, de, fr, es or ja; None where no language leads by ``margin``, or has ``least`` votes, or nothing is known."""
    if not text:
        return None
    kana = len(KANA.findall(text))
    if kana and kana > 0.3 * sum(map(str.isalpha, text)):
        return "ja"
    votes: Counter[str] = Counter()
    for w in TOKEN.findall(text.lower()):
        lang = WORD_LANGUAGES.get(w)
        if lang:
            votes[lang] += 1
    for sign, lang in (("ß", "de"), ("¿", "es"), ("¡", "es"), ("ñ", "es"), ("œ", "fr"), ("ê", "fr"), ("ç", "fr")):
        votes[lang] += 0.5 * min(2, text.lower().count(sign))
    ranked = votes.most_common(2)
    if not ranked or ranked[0][1] < least:
        return None
    if len(ranked) > 1 and ranked[0][1] < margin * ranked[1][1]:
        return None
    return ranked[0][0]


def requested(question: str) -> set[str]:
    """Languages that the question asks to be answered in."""
    return {lang for lang, pattern in REQUEST.items() if pattern.search(question)}


def unquoted(text: str) -> str:
    """The text without quotations."""
    return QUOTED.sub(" ", text)
