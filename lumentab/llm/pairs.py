"""Broken prompt and response pairs.

A row gets at most one defect, the first that holds of

empty, error, copy, refusal, other_language, truncated.

Method: the answer is traversed over a suffix automaton of the prompt, which gives for each position the longest
copied stretch ending there, and so what of the answer is covered by copies of (nearly) the whole prompt; an answer whose
uncovered rest is nothing but labels is a copy. One Aho-Corasick automaton over all phrases finds refusals and fault messages,
which must stand at the head and make up a share of the answer, however long it is; a stack of delimiters and the terminators
of the last sentence decide truncation; stopwords vote for the language.

Sentences without a terminator are held against the reference answer first (does the same stretch go on there?), then
against the ends of all sentences of the table, which are counted in one aggregation over all rows.

Nulls and empty texts: a null or empty answer is ``empty``; a null question takes part in no copy and no language test;
a null expected_behavior counts as ``answer``; a null reference gives no evidence. Rows are classed one by one, so that
repeated rows get the same class and an empty table gives an empty result. Extra columns are kept as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

# Marks that stand for nothing, compared without case and without blanks.
NOTHING = {
    "n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "undefined", "void", "empty", "{}", "[]", "()", '""', "''",
    "tbd", "todo", "k.a.", "s/o", "s.o.", "noanswer", "<null>", "<none>", "<empty>", "(empty)", "(none)", "(null)", "[null]", "[none]", "[empty]",
}

# Phrases that decline or claim to have no information, lower case, typographic apostrophes as '.
REFUSALS = {
    "en": [
        "i can't help", "i cannot help", "i can not help", "can't assist", "cannot assist", "unable to help", "unable to assist",
        "unable to answer", "unable to provide", "unable to respond", "not able to answer", "not able to help", "not able to provide",
        "can't answer", "cannot answer", "can not answer", "won't answer", "can't provide", "cannot provide", "can't share", "cannot share",
        "can't discuss", "cannot discuss", "can't say anything", "cannot say anything", "can't comment", "cannot comment", "can't tell you",
        "cannot tell you", "have to decline", "must decline", "i decline", "i refuse", "have to refuse", "must refuse", "rather not",
        "no information about", "no information on", "no information regarding", "have no information", "don't have information", "do not have information", "don't have any information",
        "do not have any information", "found no information", "couldn't find", "could not find any", "found nothing", "i don't know",
        "i do not know", "have no knowledge", "says nothing", "nothing i could pass on", "outside what i may", "outside what i can", "outside my scope", "beyond my scope",
        "isn't something i do", "is not something i do", "isn't something i can", "is not something i can", "not allowed to discuss", "not permitted to",
        "not allowed to answer", "not in a position to", "against my guidelines", "as a language model", "as an ai",
        "have no details", "no details available", "have no data", "not something i may", "no answer to this", "isn't covered by my", "not covered by my",
    ],
    "he": [
        "אינני יכול", "אינני יכולה", "אני לא יכול", "איני יכול", "לא אוכל", "אין ביכולתי", "אין באפשרותי", "אין לי אפשרות", "אין בידי", "אין לי מידע",
        "אין ברשותי", "מחוץ לתחום", "לא מצאתי מידע", "לא נמצא מידע", "אני מסרב", "עליי לסרב", "עלי לסרב", "נאלץ לסרב", "איני יודע", "אינני יודע", "אני לא יודע",
        "אינני מוסמך", "איני מוסמך", "אינני רשאי", "איני רשאי", "מעדיף שלא", "אין במאגר", "לא קיים מידע", "מתן ייעוץ", "מאגר המידע אינו", "לא מופיע דבר", "אין לי נתונים", "אין לי פרטים",
    ],
    "de": [
        "kann ich nicht helfen", "kann ich ihnen nicht", "kann ich dazu nicht", "kann ich nichts sagen", "kann ich nicht beantworten", "kann ich keine", "darf ich nicht", "darf ich keine",
        "muss ich passen", "muss ich ablehnen", "muss ich leider", "ich muss ablehnen", "ich lehne ab", "keine angaben", "keine informationen", "keine auskunft", "keine information",
        "weiß ich nicht", "ich weiß es nicht", "ich weiß nicht", "nicht in der lage", "nicht befugt", "nicht berechtigt", "außerhalb meines", "außerhalb dessen",
        "gehört nicht zu meinen", "möchte ich mich nicht", "möchte mich nicht", "ich kann nicht", "ich kann diese", "ich kann ihnen nicht", "ich kann dazu", "ich kann keine", "ich darf",
        "liegen mir keine", "liegt mir keine", "habe ich keine", "ich habe keine", "finde ich nichts", "nichts gefunden", "gibt dazu nichts her", "nichts bekannt",
    ],
    "fr": [
        "je ne peux pas", "je ne peux rien", "je ne peux ni", "je ne suis pas en mesure", "je ne suis pas autorisé", "je ne suis pas habilité", "je dois décliner", "je dois refuser",
        "je refuse", "je décline", "aucune information", "pas d'information", "aucun renseignement", "aucune donnée", "je ne sais pas", "je ne dispose", "je n'ai pas", "je n'ai aucun",
        "je n'ai rien trouvé", "dépasse ce que", "hors de mon domaine", "hors de mon champ", "hors du cadre", "je préfère ne pas", "je préférerais ne pas", "il m'est impossible", "ne relève pas de", "ne fait pas partie de ce que", "ne contient rien", "ne dit rien", "n'est pas de mon ressort", "ne puis vous",
    ],
    "es": [
        "no puedo ayudar", "no puedo responder", "no puedo contestar", "no puedo decir", "no puedo dar", "no puedo facilitar", "no puedo proporcionar", "no puedo comentar", "no puedo ofrecer", "no puedo hablar",
        "debo rechazar", "tengo que rechazar", "debo declinar", "me niego", "no dispongo", "no tengo información", "no tengo datos", "no tengo constancia", "ninguna información", "no hay información",
        "no sé", "no lo sé", "no estoy autorizad", "no me está permitido", "no me es posible", "no estoy en condiciones", "fuera de lo que puedo", "fuera de mi ámbito", "fuera de mi alcance",
        "prefiero no", "preferiría no", "no he encontrado", "no encontré", "no encuentro", "no es algo que", "no dice nada", "no contiene nada",
    ],
}

# Wordings of faults of the answering system, lower case.
FAULTS = [
    "traceback (most recent call last)", "spike arrest violation", "rate limit reached", "rate limit exceeded", "too many requests", "quota exceeded",
    "internal server error", "bad gateway", "gateway time-out", "gateway timeout", "service unavailable", "service temporarily unavailable", "upstream did not respond",
    "upstream request timeout", "connection refused", "connection reset", "connection timed out", "read timed out", "request timed out", "request timeout", "failed to build a text",
    "failed to generate", "generation failed", "failed to produce", "failed to create", "error while generating", "error generating", "an error occurred", "an unexpected error", "unexpected error", "nullpointerexception",
    "stack trace", "segmentation fault", "out of memory", "econnrefused", "etimedout", "temporary failure", "temporary fault", "answer service failed",
    "הפקת התשובה נכשלה", "יצירת התשובה נכשלה", "תקלה זמנית", "שגיאת שרת", "שגיאה פנימית", "אירעה שגיאה", "השירות אינו זמין",
    "interner fehler", "interner serverfehler", "zeitüberschreitung", "ein fehler ist aufgetreten", "dienst nicht verfügbar", "antwort konnte nicht erzeugt werden", "konnte nicht generiert werden",
    "erreur interne", "une erreur est survenue", "une erreur s'est produite", "délai d'attente dépassé", "service indisponible", "la génération de la réponse a échoué",
    "error interno", "se ha producido un error", "ha ocurrido un error", "tiempo de espera agotado", "servicio no disponible", "no se pudo generar la respuesta",
]

# Frequent function words. A word of several languages votes for each of them.
STOPWORDS = {
    "en": "the of and to in is are for with by or be from as at on an if when has have may must can will should would not no than how what which who where does do this that it its before after under until about during",
    "de": "der die das den dem des und ist sind für mit von oder zu zum zur auf im in ein eine einer einem einen wenn nach bei nicht wird werden kann soll muss darf hat wer wie was wo welche welcher wird bis vor über sobald falls weil obwohl als auch es sich dass",
    "fr": "le la les des du de et est sont pour avec par ou au aux dans sur un une si que qui quel quelle où comment quand après avant selon sous pas ne ce cette se peut doit va jusqu lorsque dès bien parce en plus",
    "es": "el la los las del de y es son para con por o al en un una si que quién qué cuál cómo cuándo dónde después antes según bajo no se puede debe podrá hasta cuando mientras aunque porque su lo está como más",
    "pt": "o os as do da dos das e é são para com por ou ao à em no na um uma se que quem qual como quando onde depois antes segundo sob não pode deve até enquanto embora porque seu sua está mais pelo pela",
    "nl": "de het een en is zijn voor met van of te op in als na bij niet wordt worden kan moet mag heeft wie hoe wat waar welke tot over zodra omdat hoewel dat die dit ook er aan om door",
    "he": "",
}
# Names of languages as a question uses them to ask for an answer in one.
LANGUAGE_NAMES = {
    "en": ["english", "englisch", "anglais", "inglés", "ingles", "אנגלית", "inglês", "engels"],
    "de": ["german", "deutsch", "allemand", "alemán", "aleman", "גרמנית", "alemão", "duits"],
    "fr": ["french", "französisch", "français", "francés", "frances", "צרפתית", "francês", "frans"],
    "es": ["spanish", "spanisch", "espagnol", "español", "castellano", "ספרדית", "espanhol", "spaans"],
    "he": ["hebrew", "hebräisch", "hébreu", "hebreo", "עברית", "hebraico", "hebreeuws"],
    "pt": ["portuguese", "portugiesisch", "portugais", "portugués", "פורטוגזית", "português", "portugees"],
    "nl": ["dutch", "niederländisch", "néerlandais", "neerlandés", "holandés", "הולנדית", "holandês", "nederlands"],
}
# Labels that may stand before a repeated question.
LABELS = {
    "question", "q", "your question", "the question", "user question", "prompt", "user", "query", "you asked", "answer", "a", "input", "re",
    "frage", "ihre frage", "die frage", "nutzer", "antwort", "f", "question posée", "votre question", "la question", "réponse", "pregunta", "su pregunta", "la pregunta", "consulta", "respuesta", "p", "שאלה", "השאלה", "שאלתך", "תשובה", "ש", "pergunta", "vraag",
}

END = ".!?…。؟"
CLOSERS = "\"'”’»)]}“‘"
PAIRS = {"(": ")", "[": "]", "{": "}", "„": "“", "“": "”", "«": "»"}
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TAG = re.compile(r"<[^<>]*>")
_HTML_FAULT = re.compile(r"(?is)^\s*(?:<!doctype[^>]*>\s*)?<html.*?<title>[^<]*(?:\b[45]\d\d\b|error|unavailable|time-?out)")
_FAULT_START = re.compile(
    r"""(?ix)^\s*(?:
    http(?:/[\d.]+)?\s+(?:error\s+)?[45]\d\d\b | (?:error|err|fehler|erreur|שגיאה)\s*[:#\d] | [45]\d\d\s+[a-z][a-z -]+$
    | (?:[a-z_]\w*\.)+\w*(?:exception|error)\b | \w+(?:exception|error)\s*: | fatal\s*: | panic\s*: | exception\b)"""
)
_SENTENCE = re.compile(r"[^.!?…]+(?:[.!?…]+(?=\s|$)|[.!?…]+(?=\S)[^.!?…]*)*")


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for p in phrases:
        made.add_word(p, p)
    made.make_automaton()
    return made


_MADE: dict[str, object] = {}


def _tools() -> dict:
    """The automata and vote tables, built once in each worker."""
    if not _MADE:
        votes: dict[str, list[str]] = {}
        for lang, words in STOPWORDS.items():
            for w in words.split():
                votes.setdefault(w, []).append(lang)
        _MADE["votes"] = votes
        _MADE["refusal"] = _automaton([p for ps in REFUSALS.values() for p in ps])
        _MADE["fault"] = _automaton(FAULTS)
        _MADE["asked"] = _automaton([n for ns in LANGUAGE_NAMES.values() for n in ns])
        _MADE["labels"] = {_letters(x) for x in LABELS}
        _MADE["lang_of"] = {n: k for k, ns in LANGUAGE_NAMES.items() for n in ns}
    return _MADE


class SuffixAutomaton:
    """Of one sequence; ``matches`` gives for each position of another the longest stretch of it that ends there."""

    def __init__(self, seq):
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in seq:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next, self.link, self.length = nxt, link, length

    def matches(self, seq) -> Iterator[int]:
        state, n = 0, 0
        for c in seq:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                n += 1
            else:
                n = 0
            yield n


WHOLE = 0.9  # of the prompt, from which a copied stretch counts
SAID = 0.25  # of an answer, that the sentences of a refusal or fault make up at least


def uncovered(question: str, answer: str, least: int) -> list[tuple[int, int]]:
    """The spans of the answer outside all stretches of at least `least` characters that stand in the question too."""
    out: list[tuple[int, int]] = []
    copied: list[tuple[int, int]] = []
    for end, n in enumerate(SuffixAutomaton(question).matches(answer), 1):
        if n >= least:
            begin = end - n
            while copied and copied[-1][0] >= begin:
                copied.pop()
            if copied and copied[-1][1] >= begin:
                begin = copied.pop()[0]
            copied.append((begin, end))
    at = 0
    for begin, end in [*copied, (len(answer), len(answer))]:
        if begin > at:
            out.append((at, begin))
        at = end
    return out


def visible(text: str) -> str:
    """text without tags, controls, format characters and outer blanks."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isprintable():
        text = "".join(" " if c.isspace() else c for c in text if unicodedata.category(c) not in ("Cf", "Cc", "Cs", "Co", "Cn") or c.isspace())
    return text.strip()


def is_nothing(text: str | None) -> bool:
    if text is None:
        return True
    seen = visible(text)
    key = re.sub(r"\s+", "", seen).lower()
    return not any(c.isalnum() for c in key) or key in NOTHING or key.strip("\"'.()[]{}<>-–—*") in NOTHING


_FAULT_KEY = re.compile(r'"(?:error|errors|errormessage|fault|faultstring|exception|traceback)"\s*:|"(?:status|state|code)"\s*:\s*(?:"?(?:failed|failure|error|fail)"?|"?[45]\d\d"?)')


def said_share(low: str, hits: list[int]) -> tuple[int | None, float]:
    """(the first sentence in which one of the places stands, the share of the text in such sentences)."""
    parts, at, first, said, total = sentences(low), 0, None, 0, 0
    for k, s in enumerate(parts):
        i = low.find(s, at)
        at = i + len(s)
        total += len(s)
        if any(i <= h < at for h in hits):
            first = k if first is None else first
            said += len(s)
    return first, said / max(1, total)


def is_fault(text: str) -> bool:
    """A payload with a key of faults, a message by its form, or one whose first sentence has a wording of faults."""
    low = text.strip().lower()
    if low.startswith(("{", "[")) and _FAULT_KEY.search(low):
        return True
    if _HTML_FAULT.match(low) or _FAULT_START.match(low) or low.startswith("traceback (most recent"):
        return True
    hits = [end - len(phrase) + 1 for end, phrase in _tools()["fault"].iter(low)]
    if not hits:
        return False
    first, share = said_share(low, hits)
    return first == 0 and share >= SAID


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _letters(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def is_copy(question: str | None, answer: str) -> bool:
    """The answer holds nothing but the question, or nearly all of it, once or again and again, perhaps under labels.

    A label is one of LABELS, or a rest that stands before the first copy and ends in a colon.
    """
    if not question:
        return False
    q, a = _letters(question), _letters(answer)
    if not q:
        return False
    least = max(1, math.ceil(WHOLE * len(q)))
    if q[len(q) - least : least] not in a:  # stands in every stretch of so many characters of the question
        return False
    rest = uncovered(q, a, least)
    if rest == [(0, len(a))]:
        return False
    labels = _tools()["labels"]
    head = answer.find(":")
    before = len(_letters(answer[:head])) if head >= 0 else -1
    return all(a[i:j] in labels or (i == 0 and j == before) for i, j in rest)


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?…])[\s\"'”»)]+|\n+", text)) if s]


def is_refusal(answer: str) -> bool:
    """A refusal is said in the first sentence, or the second after a courtesy, and makes up a share of the whole."""
    low = answer.replace("’", "'").lower()
    hits = [(end - len(p) + 1) for end, p in _tools()["refusal"].iter(low)]
    hits = [s for s in hits if s == 0 or not low[s - 1].isalnum()]
    if not hits:
        return False
    first, share = said_share(low, hits)
    return first is not None and first <= 1 and share >= SAID


def language_votes(text: str) -> dict[str, float]:
    """Votes of the lower-case function words; Hebrew by its letters."""
    votes: dict[str, float] = {}
    table = _tools()["votes"]
    hebrew = sum("א" <= c <= "ת" for c in text)
    latin = 0
    for w in _WORD.findall(text):
        for part in re.split(r"['’]", w.lower()):
            for lang in table.get(part, ()):
                votes[lang] = votes.get(lang, 0) + 1
        if w.islower() and w.isascii():
            latin += len(w)
    if hebrew > max(4, latin):
        return {"he": 1.0 + hebrew / 4}
    return votes


def language_of(text: str) -> tuple[str | None, float, dict[str, float]]:
    votes = language_votes(text)
    if not votes:
        return None, 0.0, votes
    order = sorted(votes.items(), key=lambda x: (-x[1], x[0]))
    return order[0][0], order[0][1] - (order[1][1] if len(order) > 1 else 0), votes


def own_votes(text: str, lang: str, other: str) -> int:
    """Votes for one of two languages by function words that the other hasn't."""
    votes = _tools()["votes"]
    parts = (p for w in _WORD.findall(text.lower()) for p in re.split(r"['’]", w))
    return sum(lang in v and other not in v for v in (votes.get(p, ()) for p in parts))


def in_other_language(question: str | None, answer: str) -> bool:
    if not question:
        return False
    asked, _, asked_votes = language_of(question)
    got, _, votes = language_of(answer)
    if asked is None or got is None or asked == got:
        return False
    if "he" in (asked, got):
        clear = votes[got] >= 2 and votes.get(asked, 0) <= 0.5 * votes[got]
    else:
        clear = own_votes(question, asked, got) > own_votes(question, got, asked) and own_votes(answer, got, asked) >= max(2, 2 * own_votes(answer, asked, got))
    if not clear:
        return False
    tools = _tools()
    wanted = {tools["lang_of"][n] for _, n in tools["asked"].iter(question.lower())}
    return got not in wanted


def _shape(word: str) -> str:
    """A word of the language as it is; names and numbers only as such."""
    if any(c.isdigit() for c in word):
        return "#"
    if word[:1].isupper() and len(word) > 1:
        return "^"
    return word.lower()


def ending(text: str) -> str | None:
    """The last two words of an answer without terminator, as a key for the counts of sentence ends; else null."""
    t = text.rstrip()
    while t and t[-1] in CLOSERS:
        t = t[:-1].rstrip()
    if not t or t[-1] in END:
        return None
    last = t.rsplit(None, 2)[-2:]
    return " ".join(_shape(w.strip(CLOSERS + ",;:")) for w in last) if len(last) == 2 else None


def open_delimiters(text: str) -> list[str]:
    stack: list[str] = []
    for c in text:
        if c in PAIRS and not (c == "“" and stack and PAIRS[stack[-1]] == "“"):
            stack.append(c)
        elif stack and c == PAIRS[stack[-1]]:
            stack.pop()
    return stack


def breaks_off(answer: str, reference: str | None) -> bool | None:
    """Whether the answer ends inside a word or a sentence; null where its own text and the reference don't tell."""
    t = re.sub(r"\s+$", "", answer)
    bare = t.rstrip(CLOSERS + " ")
    if not bare:
        return False
    if open_delimiters(t):
        return True
    if bare[-1] in END:
        return False
    if t[-1] in ",;:-–(" or bare[-1] in ",;(":
        return True
    stretch = re.split(r"(?<=[.!?…:;])\s+|\s[-–]\s", bare)[-1]
    if reference and len(stretch) >= 8:
        verdicts = set()
        i = reference.find(stretch)
        while i >= 0:
            after = reference[i + len(stretch) :].lstrip(CLOSERS)
            verdicts.add(bool(after) and after[0] not in END and not (after[0].isspace() and not after.strip()))
            i = reference.find(stretch, i + 1)
        if verdicts:
            return verdicts == {True}
    if len(stretch.split()) <= 2:  # a sentence just begun; as the whole answer, a short one
        return len(stretch) < len(bare)
    return None


def first_defect(question: str | None, answer: str | None, behavior: str | None, reference: str | None) -> str:
    """The defect, '' for none, or '?' + the key of the ending where only the counts of sentence ends can tell."""
    if is_nothing(answer):
        return "empty"
    if is_fault(answer):
        return "error"
    if is_copy(question, answer):
        return "copy"
    if (behavior or "").strip().lower() != "abstain" and is_refusal(answer):
        return "refusal"
    refused = is_refusal(answer)
    if in_other_language(question, answer):
        return "other_language"
    if refused:
        return ""
    off = breaks_off(answer, reference)
    if off is None:
        key = ending(answer)
        return f"?{key}" if key else ""
    return "truncated" if off else ""


@F.pandas_udf(T.StringType())
def _first_defect(question: pd.Series, answer: pd.Series, behavior: pd.Series, reference: pd.Series) -> pd.Series:
    none = lambda s: s.astype(object).where(s.notna(), None)
    return pd.Series([first_defect(*x) for x in zip(none(question), none(answer), none(behavior), none(reference))], dtype=object)


def sentence_ends(texts: DataFrame, column: str) -> DataFrame:
    """How often each pair of last words ends a sentence of column, and how often it goes on, over all rows."""
    # stays in the JVM: the text is cut at its terminators once, and of each sentence only the last two words are looked at
    shape = lambda w: F.when(w.rlike("[0-9]"), "#").when(w.rlike(r"^\p{Lu}."), "^").otherwise(F.lower(w))
    parts = F.split(F.col(column), r"[.!?…]+(?:\s+|$)")
    tails = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.substring_index(s, " ", -2))
    words = F.split(F.regexp_replace("_pair", r"[,;:()\"]", ""), r"\s+")
    return (
        texts.where(F.col(column).isNotNull())
        .select(F.explode(F.array_distinct(tails)).alias("_pair"))
        .groupBy("_pair").agg(F.count("*").alias("_n"))
        .select(words.alias("_w"), "_n").where(F.size("_w") == 2)
        .groupBy(F.concat(shape(F.col("_w")[0]), F.lit(" "), shape(F.col("_w")[1])).alias("_key"))
        .agg(F.sum("_n").alias("_ends"))
    )


def flag_pairs(
    df: DataFrame,
    question: str = "question",
    answer: str = "answer",
    behavior: str | None = "expected_behavior",
    reference: str | None = "expected_answer",
    defect: str = "defect",
) -> DataFrame:
    """df with the column defect: the type of the row's defect, null for a sound pair."""
    col = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    first = df.withColumn("__first", _first_defect(col(question), col(answer), col(behavior), col(reference)))
    ends = sentence_ends(df.select(F.explode(F.array(*[col(c) for c in (answer, reference) if c])).alias("_text")), "_text")
    # an ending is one of the language if it makes up a share of all of them: endings of other broken answers don't
    ends = staged(ends, "sentence-ends")  # counted once
    total = ends.agg(F.sum("_ends")).first()[0] or 0
    ends = ends.where(F.col("_ends") >= max(2.0, 3e-5 * total))
    open_key = F.when(F.col("__first").startswith("?"), F.expr("substring(__first, 2)"))
    out = first.withColumn("__key", open_key).join(ends.withColumnRenamed("_key", "__key"), "__key", "left")
    verdict = (
        F.when(~F.col("__first").startswith("?"), F.when(F.col("__first") != "", F.col("__first")))
        .when(F.col("_ends").isNull(), F.lit("truncated"))
    )
    return out.withColumn(defect, verdict).drop("__first", "__key", "_ends")
