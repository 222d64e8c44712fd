"""Problem 10: template residue, filler, error pages and script notices.

1. Lines are normalised (case, numbers, reference ids, blanks) and counted by
   host over all documents; a line that recurs within its host and is no
   evidence itself is boilerplate and counts for nothing.
2. Texts with any cue are cut into segments (lines, sentences, and the parts of
   a sentence around a message).  A segment is evidence, content or neither
   (navigation).  Evidence is told by the general wording of error pages, script
   notices and unfinished pages (word classes in five languages, not sentences of
   any corpus), by holes of templates in little text, and by filler: pseudo-Latin
   around known filler words without any function word of a real language.
3. Segments that no wording tells are told by statistics: one that stands in at
   least ``LINKED`` documents, nearly all of them mostly evidence already, is
   evidence too.  So the standing sentences of a site's error pages and templates
   are learned from the corpus.
4. A document whose residual is mostly evidence is excluded; a text that only
   mentions or quotes a message keeps its content and stays.

A text without any cue is never evidence by the definition of a cue: each
pattern names the words without which it is not tried, and holes and repeated
words are searched in every text.

Edge cases: NULL, empty and blank texts are never cases; a NULL host is a host
of its own; repeated rows each count; texts are read whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import spread, written

#: A line recurs in its host if it is in so many documents of it and in this share of them.
RECURS, RECURS_SHARE = 5, 0.002
#: Share of a segment that evidence must cover; share of the residual that must be evidence.
COVERED, MOSTLY = 0.55, 0.6
#: Letters and digits of text that one placeholder may stand among.
PER_PLACEHOLDER = 45
#: Documents and share of them that must be mostly evidence for their common segment to be evidence.
LINKED, LINKED_SHARE, SEEDED = 3, 0.8, 0.3

_TAIL = r"(?:,?\s+(?:to|in order to|before|and|then|um|damit|pour|afin|para|so)\b[^.!?\n。]{0,80})?"
_JS = r"(?:java\s?script|js|scripts?|scripting|cookies|skripte)"
_PLACE = r"(?:page|site|website|file|url|uri|resource|address|link|document|view|content|item|record|memory|article|entry)"

#: The wording of error pages, by the words without which a pattern is not tried.
ERRORS: list[tuple[str, str]] = [
    (
        "bad request|payment required|not found|method not allowed|not acceptable|timeout|time-out|payload too large|unsupported media|too many requests|server error|not implemented|bad gateway|unavailable",
        r"(?:(?:http|status|error|code|fehler|erreur)[\s:]*)*(?:\b[45]\d\d\b[\s:.,–-]*)?\b(?:bad request|payment required|(?:page |file |url |object )?not found|method not allowed|not acceptable|request time-?out|gateway time-?out|payload too large|unsupported media type|too many requests|(?:internal )?server error|not implemented|bad gateway|service (?:temporarily )?unavailable)\b(?:\s*\(?(?:error\s*)?[45]\d\d\b\)?)?",
    ),
    ("unauthorized|forbidden|conflict|gone", r"(?:error\s*)?\b[45]\d\d\b[\s:.,–-]*(?:unauthorized|forbidden|conflict|gone)\b|\b(?:unauthorized|forbidden|conflict|gone)\b\s*\(?(?:error\s*)?[45]\d\d\b\)?|^\W*(?:unauthorized|forbidden)\W*$"),
    ("error 4|error 5|error: 4|error: 5|error code|fehler 4|fehler 5|erreur 4|erreur 5", r"\b(?:http\s+)?(?:error|fehler|erreur)\s*(?:code\s*)?:?\s*[45]\d\d\b(?:\s*[:–-]\s*\w+(?: \w+)?)?"),
    ("not found|not be|n't be|n’t be|not exist|n't exist|n’t exist|no longer avail|not avail|not been found", rf"(?:the |this |that |your |requested )*{_PLACE}\b(?: you\w* \w+(?: \w+)?(?: for)?)?\s+(?:was not found|not found|(?:could|can)(?:\s?not|n?['’]t) be (?:found|displayed|loaded|shown|reached)|does(?: not|n't|n’t) exist|is no longer available|is not available|has not been found)(?: on this (?:server|site))?"),
    ("t find", rf"(?:sorry,? |oops\W* )?we (?:could|can)(?:\s?not|n?['’]t) find (?:that|the|this|your)(?: requested)? {_PLACE}(?: you[^.!?\n]{{0,40}})?"),
    ("looking for", rf"(?:the )?{_PLACE} you(?:'re| are| were) looking for[^.!?\n]{{0,60}}"),
    ("may be|may have|might be|might have", rf"(?:the )?(?:link|{_PLACE})(?: you (?:followed|clicked|requested|entered))? (?:may|might) (?:be|have been) (?:broken|moved|removed|deleted|renamed|out of date)(?:,? or (?:the )?{_PLACE} (?:may|might) (?:be|have been) \w+)?"),
    ("access denied|access is|access has|access restricted|have permission|have the permission|have access|authori|permission denied|not allowed|not permitted", r"\baccess (?:is |has been )?(?:denied|restricted)\b|you (?:do not|don't|don’t) have (?:the )?(?:permissions?|access|authori[sz]ation)(?: (?:to|for)[^.!?\n]{0,50})?|you are not (?:authori[sz]ed|allowed|permitted) to[^.!?\n]{0,50}|permission denied"),
    ("went wrong|gone wrong|occurred|happened|encountered", r"(?:oops\W*|sorry,? )?(?:something (?:has |just )?(?:went|gone) wrong|(?:an? )?(?:unexpected |internal |unknown |fatal |server |temporary |technical )*(?:error|problem) (?:has |just |was )?(?:occurred|happened|encountered))(?: (?:on our (?:side|end)|while [^.!?\n]{0,50}))?"),
    ("n error|l error|e error|x error|y error|) error|d error", r"\b(?:application|fatal|runtime|parse|syntax|internal|database(?: connection)?|connection|unexpected|critical|gateway|proxy) error\b(?:: *(?:uncaught )?(?:exception|error)\b)?"),
    ("uncaught|unhandled|traceback|stack trace", r"\b(?:uncaught|unhandled) (?:exception|error)\b[^.!?\n]{0,60}|traceback(?: \(most recent call last\))?\s*:?(?: *\S+ failed(?: at line \S+(?: \d+)?)?)?|stack trace\s*:"),
    ("session has|session expired|session timed|session ended|in to ", r"your (?:login )?session (?:has )?(?:expired|timed out|ended)|(?:please )?(?:sign|log) in (?:again )?to (?:continue|proceed|view[^.!?\n]{0,30})"),
    ("sign in again|log in again", r"please (?:sign|log) in again(?: to continue)?"),
    ("again|check back|reload the|reload this|refresh the|refresh this|back later", r"(?:please )?(?:try|check) (?:it )?(?:again|back)(?: (?:later|soon|shortly|in (?:\S+ ){1,3}(?:seconds|minutes|hours)|in a (?:few |moment|minute)\w*(?: \w+)?))?|please (?:reload|refresh) (?:the|this) page[^.!?\n]{0,30}|(?:please )?come back later"),
    ("administrator|admin|webmaster|support|helpdesk", r"(?:please )?contact (?:the |your |our )?(?:site |system |web)?\s?(?:administrator|admin|webmaster|support(?: team)?|helpdesk)[^.!?\n]{0,50}"),
    ("problem persists|error persists|issue persists|continues", r"if (?:the|this) (?:problem|error|issue) (?:persists|continues)[^.!?\n]{0,60}"),
    ("request id|error id|incident id|trace id|correlation id|ray id|event id|support id|error code|error number|t number|t code|quote reference|quote this|ref. |ref.:|reference:", r"\b(?:request|error|incident|trace|correlation|ray|event|support) (?:id|number|code)\b\s*:?\s*(?:txn )?\S+|(?:please )?quote (?:this )?reference\s*:?\s*(?:txn )?\S+|^\W*(?:ref\.|reference:?)\s*(?:txn )?\S+\W*$"),
    ("upstream|refused|reset|connection|not respond|t respond|not answer|t answer|not reply|t reply", r"upstream (?:connect|request) (?:error|time-?out)[^.!?\n]{0,40}(?::? ?\S*)|connection (?:was )?(?:refused|reset|timed out|closed)(?: by (?:peer|host|server))?|(?:the |this )?(?:\w+ )?(?:server|service|host|backend|site) (?:did not|didn't|didn’t|is not|isn't) (?:respond|answer|reply|responding|answering)(?:ing)?(?: in time)?"),
    ("maintenance|unavailable|is down|is currently|is temporarily|is offline", r"(?:the |this )?(?:\w+ )?(?:server|service|site|page|system) is (?:currently |temporarily )?(?:unavailable|down|offline|under maintenance)[^.!?\n]{0,30}|(?:scheduled|down for) maintenance"),
    ("been told|been notified|been informed|been alerted|looking into|working on", r"(?:we|our (?:team|engineers|staff|administrators?)) (?:have|has) been (?:told|notified|informed|alerted)(?: and (?:are|is) [^.!?\n]{0,40})?|we(?:'re| are) (?:looking into|working on) (?:it|this|the (?:problem|issue))"),
    ("home page|homepage|start page|main page|front page|previous page", r"(?:return|go back|back|go) to (?:the |our )?(?:home|start|main|front|previous)\s?page"),
    ("versuchen sie|nicht gefunden|verweigert|gefunden werden|aufgetreten|serverfehler", r"(?:bitte )?versuchen sie es (?:bitte )?(?:später|in \w+ \w+)(?: (?:erneut|noch einmal|wieder))?|(?:die )?(?:angeforderte )?(?:seite|datei) (?:wurde )?(?:leider )?nicht gefunden|konnte nicht gefunden werden|zugriff verweigert|(?:es ist )?ein (?:\w+ )?fehler (?:ist )?aufgetreten|interner serverfehler"),
    ("réessayer|introuvable|non trouvée|accès|une erreur|du serveur|n'existe", r"(?:veuillez )?réessayer (?:plus tard|ultérieurement|dans [^.!?\n]{0,20})|(?:la )?page (?:est )?(?:introuvable|non trouvée)|(?:la )?page (?:demandée )?n'existe (?:pas|plus)|accès (?:refusé|interdit)|une erreur (?:est survenue|s'est produite)|erreur (?:interne )?du serveur"),
    ("ntelo de nuevo|no encontrada|denegado|un error|del servidor|no existe", r"(?:por favor,? )?int[eé]ntelo de nuevo(?: más tarde)?|(?:la )?página (?:no encontrada|no existe|solicitada no existe)|acceso denegado|(?:se )?ha (?:ocurrido|producido) un error|error (?:interno )?del servidor"),
    ("見つかり|もう一度|拒否|エラー|しばらく", r"(?:お探しの)?ページ[がは]?見つかりません(?:でした)?|(?:しばらくしてから)?もう一度お試し(?:ください)?|アクセス[がは]拒否されました|エラーが発生しました"),
]
#: Notices that scripts are required.
SCRIPTS: list[tuple[str, str]] = [
    ("enable|activate|allow|turn on|switch on", rf"(?:please |you (?:need|have|must) (?:to )?|to \w+ this \w+,? )*\b(?:enable|activate|allow|turn on|switch on)\s+{_JS}\b(?: (?:on|in your browser))?{_TAIL}"),
    ("disabled|turned off|switched off| off|blocked|required|needed|enabled|turned on|scripts on|script on|cookies on|js on", rf"\b{_JS}\s+(?:(?:is|are|must be|has to be|seems? to be) )?(?:(?:currently )?(?:disabled|turned off|switched off|off|blocked)|(?:required|needed|enabled|turned on)(?: here)?)\b(?: in your browser)?{_TAIL}|\bturn {_JS} on\b{_TAIL}"),
    ("script|cookies| js", rf"(?:(?:this|the|our) (?:\w+ )?)?\b(?:requires?|needs?|relies on|works? (?:only|best) with) {_JS}\b{_TAIL}"),
    ("your browser|the browser|if your|checking if", rf"your browser (?:does not|doesn't|doesn’t) (?:support|allow|run) {_JS}{_TAIL}(?:,? so [^.!?\n]{{0,60}})?|checking (?:your|the|if (?:the|your)) browser[^.!?\n]{{0,60}}|please (?:upgrade|update) your browser[^.!?\n]{{0,40}}"),
    ("you are|security of your connection", r"(?:please )?(?:verify(?:ing)?|confirm) (?:that )?you are (?:a |not a )?(?:human|robot)|(?:review|check)ing the security of your connection[^.!?\n]{0,30}"),
    ("loading|please wait", r"^\W*(?:loading|please wait)\W*$|\bloading\s*(?:…|\.\.\.)"),
    ("aktivieren|schalten|erforderlich|deaktiviert", rf"(?:bitte )?(?:aktivieren|erlauben) sie (?:\w+ )?{_JS}[^.!?\n]{{0,50}}|(?:bitte )?{_JS} (?:aktivieren|einschalten|ist (?:deaktiviert|erforderlich|ausgeschaltet))"),
    ("activer|activez|désactivé|requis|nécessaire", rf"(?:veuillez )?activ(?:er|ez) (?:le )?{_JS}{_TAIL}|{_JS} (?:est )?(?:désactivé|requis|nécessaire)"),
    ("active|activa|habilit", rf"(?:por favor,? )?(?:activ[ea]r?|habilit[ea]r?) (?:el )?{_JS}{_TAIL}|{_JS} (?:está )?(?:desactivado|deshabilitado)"),
    ("有効", r"[^。\n]{0,30}(?:スクリプト|javascript)を有効に(?:して|する)[^。\n]{0,20}"),
]
#: Pages that were never written.
UNFINISHED: list[tuple[str, str]] = [
    ("coming soon|construction", r"(?:(?:more |new )?(?:content|page|text|details) )?(?:is )?coming soon|(?:this (?:page|site|section) is )?(?:still )?under construction"),
    ("todo|tbd|fixme|tba", r"\b(?:todo|tbd|tba|fixme)\b(?:\s*:\s*(?:write|add|fill|insert|complete)[^.!?\n]{0,40})?"),
    ("text here|content here|title here|copy here|description here|body here|headline here|caption here|goes here|go here", r"(?:(?:insert|add|enter|put|your|write) )*(?:text|content|title|copy|description|body|headline|caption)(?: goes| go)? here\b"),
    ("sample |dummy |filler |placeholder|example |temporary |draft |left blank", r"\b(?:sample|dummy|filler|placeholder|example|temporary|draft) (?:text|copy|content)\b|\bplaceholder\b|^\W*this (?:page|section) (?:is )?(?:intentionally )?left blank\W*$"),
    ("test test", r"\btest(?: test)+(?: \d+)?\b"),
    ("platzhaltertext|blindtext|mustertext|beispieltext|text folgt|texto de|texte", r"\b(?:platzhalter|blind|muster|beispiel)text\b|\btext folgt\b|\btexto de (?:relleno|ejemplo|prueba|muestra)\b|\btexte (?:à venir|de remplissage|provisoire|d['’]exemple|fictif)\b"),
    ("próximamente|construcción|construction|in arbeit", r"\bpróximamente\b|\ben (?:construcción|construction)\b|seite (?:ist )?(?:noch )?in arbeit"),
    ("ダミー|準備中|工事中|サンプル", r"(?:ダミー|サンプル)(?:の)?テキスト|(?:この(?:ページ|項目)は)?(?:現在)?(?:準備中|工事中)(?:です)?"),
]
#: The words of the common filler text.
FILLER = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Filler words that are no words of the languages at hand; filler has one of them.
SEEDS = FILLER - set("sit sed do ut et dolor dolore ad ex ea in esse eu non sunt culpa qui id est nulla minim magna labore velit".split())
#: Function words; a segment with any is no filler.
FUNCTION_WORDS = set(
    "the of and to is was are were for with that this it on by from as at be not have has an or which when who und der die das den dem ein eine ist nicht mit von für auf zu im les des une du dans pour par sur qui que pas avec los las una del que con por para como el la le".split()
) - FILLER
#: Placeholders that were never filled in.
PLACEHOLDERS = [
    r"\{\{[^{}]{0,60}\}\}", r"\$\{[^{}]{0,60}\}", r"<%=?[^<>%]{0,60}%>", r"\[\[[^\[\]]{1,60}\]\]", r"#\{[^{}]{1,60}\}", r"\[(?:insert|your|add|enter) [^\[\]]{1,60}\]",
    r"(?<!\w)__[A-Za-z][A-Za-z0-9_ ]{0,40}?__(?!\w)", r"(?<![\w%])%[A-Za-z_]{2,40}%(?!\w)", r"\{[A-Za-z_]{2,40}\}", r"<(?:[a-z]+_)*(?:name|date|title|owner|team|project|ticket|summary|link|version|amount|agent|due|number|email|company|address)>", r"@@\w{2,40}@@",
    r"\[[a-z]+(?:[ _][a-z]+){0,3}\]", r"(?<!\w)x{4,}(?!\w)", r"_{4,}",
]
#: Merge fields in capitals, run together or with an underscore.
FIELD = r"(?<!\w)(?:FIRST|LAST|FULL|USER|CUSTOMER|CLIENT|COMPANY|ORDER|INVOICE|ACCOUNT|PRODUCT|RECIPIENT|SENDER|EVENT|DUE|START|END)_?(?:NAME|NUMBER|ID|DATE|CODE|EMAIL|ADDRESS|AMOUNT|TOTAL)(?!\w)"
#: One word said again and again is filler too.
REPEATED = r"\b(\w{2,12})\b(?:[ ,.]+\1\b){2,}"
#: Navigation of pages: short items between bars or dots, or one such item alone; neither evidence nor content.
_ITEM = r"(?:©\s?\w+(?: \w+)?|\w{1,20}(?: (?:in|us|up|out|page))?|a: ?\d*)"
NAVIGATION = r"(?:home|search|menu|contact|help|docs|start|about|top|back|next|previous|imprint|privacy|terms|login|sign in|log in|sign up)"

PATTERNS = [(tuple(words.split("|")), re.compile(p, re.I | re.M)) for words, p in (*ERRORS, *SCRIPTS, *UNFINISHED)]
HOLES = re.compile(r"(?=[\[{<$%#@_xX])(?:" + "|".join(PLACEHOLDERS) + ")", re.I)
FIELDS = re.compile(FIELD)
AGAIN = re.compile(REPEATED, re.I)
#: The start of a placeholder; without any a text has none.
OPENERS = re.compile(r"[\[{<$%#@]|__|xxxx", re.I)
QUOTED = re.compile(r"`[^`\n]{1,200}`|\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|«[^»\n]{1,200}»|„[^“\n]{1,200}“")
NAV = re.compile(rf"(?:^|(?<=[\s|·•])){_ITEM}(?:\s*[|·•]\s*{_ITEM})+", re.I | re.M)
NAV_ALONE = re.compile(rf"^\W*{NAVIGATION}\W*$", re.I | re.M)
BARS = re.compile(r"[|·•]")
TAGS = re.compile(r"</?(?:html|head|body|p|div|span|br|h\d|title|noscript|a)\b[^<>]{0,200}>", re.I)
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
SEGMENT = re.compile(r"[\n\r  ]+|(?<=[.!?…。！？])[\s\"”’)]+")
ALNUM = re.compile(r"[^\W_]+")
REFERENCE = r"run-[0-9a-f]+|gx-\d+|txn \d+|#\d+|\b[0-9a-f]{8,}\b|\d+\.\d+\.\d+-[0-9a-f]+"
VARYING = re.compile(rf"(?:{REFERENCE}|\d+)", re.I)
#: What a segment is.
CONTENT, EVIDENCE, OPEN = 0, 1, 2


class Cues:
    """Which patterns a text may hold: one pass over the text for all their words."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        by: dict[str, set[int]] = {}
        for i, (words, _) in enumerate(PATTERNS):
            for w in words:
                by.setdefault(w, set()).add(i)
        for w in SEEDS:
            by.setdefault(w, set()).add(-1)
        for w, which in by.items():
            self.automaton.add_word(w, tuple(which))
        self.automaton.make_automaton()

    def of(self, text: str) -> set[int]:
        """The patterns to try; -1 stands for a filler word."""
        which: set[int] = set()
        for _, found in self.automaton.iter(text.lower()):
            which.update(found)
        return which

    def any(self, text: str) -> bool:
        """Whether the text has a message, a filler word, a hole or a repeated word."""
        if "<" in text:
            text = TAGS.sub("\n", text)
        which = self.of(text)
        if -1 in which or any(PATTERNS[i][1].search(text) for i in which):
            return True
        return has_hole(text) or FIELDS.search(text) is not None or AGAIN.search(text) is not None


_CUES: list[Cues] = []


def cues() -> Cues:
    if not _CUES:
        _CUES.append(Cues())
    return _CUES[0]


def size(s: str) -> int:
    return sum(map(len, ALNUM.findall(s)))


def key(seg: str) -> int:
    """Hash of a segment without its case, numbers, references, blanks and signs."""
    return xxhash.xxh64_intdigest(" ".join(ALNUM.findall(VARYING.sub("0", seg.lower())))) - 2**63


def has_hole(text: str) -> bool:
    return OPENERS.search(text) is not None and HOLES.search(text) is not None


def messages(text: str) -> list[tuple[int, int]]:
    """The joined places of all messages in a text."""
    found = sorted(m.span() for i in cues().of(text) if i >= 0 for m in PATTERNS[i][1].finditer(text) if m.end() > m.start())
    out: list[tuple[int, int]] = []
    for a, z in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def parted(text: str) -> Iterator[tuple[int, int]]:
    """Places of the lines and sentences."""
    at = 0
    for m in SEGMENT.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _filled(words: list[str], known: set[str]) -> bool:
    """Whether the words are pseudo-Latin around known filler words."""
    if len(words) < 2 or any(w in FUNCTION_WORDS for w in words):
        return False
    seeds = len({w for w in words if w in SEEDS})
    share = sum(w in FILLER or w in known for w in words) / len(words)
    return (seeds >= 1 and (share >= 0.5 or seeds >= 2 or len(words) <= 10)) or (bool(known) and share >= 0.3)


def segments(text: str, recurrent: set[int] = frozenset()) -> list[tuple[int, int, int]]:
    """(key, letters and digits, kind) of each segment; ``recurrent`` holds the places of boilerplate lines."""
    kept = text
    if recurrent:
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in recurrent or has_hole(x) or FIELDS.search(x) or messages(x))
    if "<" in kept:
        kept = TAGS.sub("\n", kept)
    out: list[tuple[int, int, int]] = []
    if "```" in kept:
        out += [(0, size(block), CONTENT) for block in FENCE.findall(kept)]
        kept = FENCE.sub("\n", kept)
    kept = NAV_ALONE.sub("\n", kept)
    if BARS.search(kept):
        holes = [m.span() for m in HOLES.finditer(kept)]  # a bar within a placeholder is no navigation
        kept = NAV.sub(lambda m: m.group() if any(a < m.end() and m.start() < z for a, z in holes) else "\n", kept)
    # quoted messages are mentions: they stay in the text, as content
    bare = QUOTED.sub(lambda m: " " * len(m.group()), kept)
    spans, at = messages(bare), 0
    said_again, fields, opened = AGAIN.search(bare), FIELDS.search(bare), has_hole(kept)
    plain: list[str] = []
    for lo, hi in parted(kept):
        while at < len(spans) and spans[at][1] <= lo:
            at += 1
        seg, own = kept[lo:hi], bare[lo:hi]
        total = size(seg)
        if not total:
            if opened and has_hole(seg):
                out.append((0, 1, EVIDENCE))
            continue
        if said_again and sum(size(m.group()) for m in AGAIN.finditer(own)) >= COVERED * total:
            out.append((0, total, EVIDENCE))
            continue
        holes = (len(HOLES.findall(own)) if opened else 0) + (len(FIELDS.findall(own)) if fields else 0)
        if holes:
            outside = size(FIELDS.sub(" ", HOLES.sub(" ", own)))
            if outside <= PER_PLACEHOLDER * holes and not (holes == 1 and outside > 0.75 * PER_PLACEHOLDER):
                out.append((0, total, EVIDENCE))
                continue
        mine = []
        for a, z in spans[at:]:
            if a >= hi:
                break
            mine.append((max(a, lo) - lo, min(z, hi) - lo))
        if mine and sum(size(own[a:z]) for a, z in mine) >= COVERED * total:
            out.append((0, total, EVIDENCE))
            continue
        if not mine:
            plain.append(seg)
            continue
        end = 0
        for a, z in [*mine, (len(own), len(own))]:
            if size(seg[end:a]):
                plain.append(seg[end:a])
            if size(own[a:z]):
                out.append((0, size(own[a:z]), EVIDENCE))
            end = z
    known: set[str] = set()
    left = [(s, ALNUM.findall(s.lower())) for s in plain]
    while True:  # what stands beside filler words in filler is filler in this text
        new = [(s, w) for s, w in left if _filled(w, known)]
        if not new:
            break
        left = [(s, w) for s, w in left if not _filled(w, known)]
        for s, w in new:
            known.update(w)
            out.append((0, size(s), EVIDENCE))
    out += [(key(s), size(s), OPEN) for s, _ in left]
    return out


def share(segs: list[tuple[int, int, int]], linked: set[int] = frozenset()) -> float:
    """Share of evidence in the residual."""
    evidence = sum(n for k, n, kind in segs if kind == EVIDENCE or (kind == OPEN and k in linked))
    return evidence / max(1, sum(n for _, n, _ in segs))


def is_residue(text: str | None, recurrent: set[int] = frozenset(), linked: set[int] = frozenset()) -> bool:
    if not text or not text.strip() or not cues().any(text):
        return False
    segs = segments(text, recurrent)
    return any(kind == EVIDENCE for _, _, kind in segs) and share(segs, linked) >= MOSTLY


def normal_line(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), REFERENCE, "0")
    c = F.regexp_replace(c, r"\d+", "0")
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[\s.!?…·|-]+|[\s.!?…·|-]+$", "")


def boilerplate(docs: DataFrame, host: str, text: str, recurs: int = RECURS, share: float = RECURS_SHARE) -> DataFrame:
    """(host, line): hashes of the normalised lines that recur within their host; empty lines are none."""
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.split(text, "\n").alias("lines"))
    hashed = F.array_distinct(F.transform(F.filter(F.transform("lines", normal_line), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = rows.select("host", F.explode(hashed).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return counts.where(F.col("n") >= recurs).join(total, "host").where(F.col("n") >= share * F.col("docs")).select("host", "line")


def linked_segments(segs: DataFrame, least: int = LINKED, most: float = LINKED_SHARE) -> DataFrame:
    """(k): keys of the segments that stand almost only in documents that are evidence already."""
    seeded = F.aggregate("segs", F.lit(0).cast("long"), lambda s, x: s + F.when(x["kind"] == EVIDENCE, x["n"]).otherwise(0)) >= SEEDED * F.aggregate("segs", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    keys = F.array_distinct(F.transform(F.filter("segs", lambda x: x["kind"] == OPEN), lambda x: x["k"]))
    each = segs.select(F.explode(keys).alias("k"), seeded.cast("int").alias("seeded"))
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("docs"), F.sum("seeded").alias("of")).where((F.col("docs") >= least) & (F.col("of") >= most * F.col("docs"))).select("k")


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id): the documents to exclude."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.col(text).alias("text"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = cues().any
        for b in batches:
            yield b.filter(pa.array([bool(t) and test(t) for t in b.column(2).to_pylist()], pa.bool_()))

    seen = spread(rows).mapInArrow(possible, f"doc_id {kind}, host string, text string")
    seen = written(seen.withColumn("row", F.monotonically_increasing_id()), "possible-residue")
    lines = seen.select("row", "host", F.posexplode(F.split("text", "\n")).alias("pos", "x")).select("row", "host", "pos", normal_line(F.col("x")).alias("x")).where("x <> ''")
    lines = lines.select("row", "host", "pos", F.xxhash64("x").alias("line"))
    again = lines.join(boilerplate(docs, host, text), ["host", "line"], "left_semi").groupBy("row").agg(F.collect_set("pos").alias("recurrent"))
    part = pa.struct([("k", pa.int64()), ("n", pa.int32()), ("kind", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                segs = [[{"k": k, "n": n, "kind": kind} for k, n, kind in segments(t, set(r or ()))] for t, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                ok = pa.array([any(x["kind"] == EVIDENCE for x in s) for s in segs], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(segs, pa.list_(part))], names=["row", "doc_id", "segs"]).filter(ok)

    segs = seen.join(again, "row", "left").select("row", "doc_id", "text", "recurrent").mapInArrow(cut, f"row long, doc_id {kind}, segs array<struct<k: long, n: int, kind: int>>")
    segs = written(segs, "residue-segments")
    each = segs.select("row", "doc_id", F.explode("segs").alias("x")).select("row", "doc_id", "x.*")
    sure = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("total"), F.sum(F.when(F.col("kind") == EVIDENCE, F.col("n")).otherwise(0)).alias("evidence"))
    more = each.where(F.col("kind") == OPEN).join(linked_segments(segs), "k", "left_semi").groupBy("row").agg(F.sum("n").alias("more"))
    return sure.join(more, "row", "left").where(F.col("evidence") + F.coalesce("more", F.lit(0)) >= MOSTLY * F.col("total")).select("doc_id").distinct()
