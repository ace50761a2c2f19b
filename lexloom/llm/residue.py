"""Template residue, filler, error pages and script notices in the place of content.

Character n-gram models of filler, of error and script notices, of unfilled slots and of
natural prose give every character a likelihood ratio; windows of it localise residue. The
models start from phrases of our own, from rules (runs of words, keys side by side, the status
phrases of the web's standard, names within marks) and from the distinct sentences of all
documents, so that copies of one residue don't become prose, and are refitted to what they
found. A record is excluded when residue covers one of its sentences, or when an unfilled
slot stands in a sentence that doesn't speak about slots.
A whole Arrow batch is scored as arrays of code points.
"""

from __future__ import annotations

import http
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from .canonical import _points

# ---- fixed values: what the models start from, in our own words ------------------------
#: Words that fill space, written in runs; keys that lie side by side.
FILL_WORDS = "test text dummy ord word wort xxx bla blaha blah foo bar baz sample exempeltext beispieltext blindtext lorem platzhalter placeholder"
FILL_MARKS = "- * _ . # = ~"
KEY_ROWS = "asdf qwer zxcv hjkl jklö jklä uiop fdsa rewq vcxz"
#: The words of the usual Latin filler.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur
"""
#: Sentences that stand in for content still to come.
STANDINS = """
this is only a sample text, to be replaced. the sample text must be replaced before the release. a sample stands here. the real entry comes later. the real text follows later.
placeholder for the entry text. this placeholder will be replaced with the wording of the article. the text for this entry goes here. content follows. content will be added here later. coming soon.
det här är bara en platshållare. platshållaren ska bytas ut mot text. byt ut den mot en riktig artikel. det här är en exempeltext och ska ersättas före tryckning.
artikeln är bara ett test av layouten och saknar innehåll. en testartikel, skapad för prov utan innehåll. en förklaring av ordet kommer så småningom. här ska så småningom en förklaring stå. texten kommer här senare.
dies ist nur ein beispieltext. der beispieltext wird noch durch den text ersetzt. der platzhalter wird später ersetzt. der text des eintrags folgt später. hier folgt später der inhalt. ein blindtext ohne inhalt.
"""
#: What servers say when they have nothing else to say; the status phrases of the web's standard are added by rule.
FAILURES = """
oops! that went wrong. oops, something has gone wrong here. something broke on the way. our team has been notified. please try it again later. please try again in a moment. we are sorry for the trouble.
the page could not be found. the page you requested was not found. the file you asked for does not exist. the requested resource could not be delivered. the scan could not be loaded. the server could not answer the request. the server met an error.
the connection to the database failed. database error: too many connections, clients refused (ref a1b2c3). connection to the server refused. the connection has timed out. the request took too long and timed out.
access was denied. access is blocked. automated requests have been blocked. robots are blocked here. you have no permission to see this. you are not authorized. incident number 00. your session is over. session expired. please log in again to continue reading. the session has expired, log in once more.
too many requests in a short time, slow down. rate limit reached. retry later.
traceback (most recent call first): file "app.py", line 00, in get file "main.py", line 00, in main keyerror: 'name' valueerror: bad value typeerror: attributeerror: 'nonetype' indexerror: exception in thread main: java.lang.illegalstateexception: null at com.example.app(app.java:00) caused by:
hoppsan! något gick tyvärr fel. något har gått fel när sidan skulle visas. ett fel uppstod när texten skulle hämtas. kontakta oss om felet är kvar. kontakta redaktionen vid fel. försök igen senare. försök på nytt om en liten stund. referensnummer 00. sidan hittades inte. sidan finns inte längre. det gick inte att hitta sidan. servern svarar inte. tjänsten svarar inte. tjänsten är inte nåbar just nu. fel på servern. internt fel i servern. felaktigt svar från servern. tiden gick ut innan svaret kom. tidsgränsen har överskridits. för många anrop, för många förfrågningar på kort tid. åtkomsten nekades. du har inte behörighet till sidan. behörighet saknas. din inloggning har gått ut. sessionen har gått ut. du måste logga in igen för att läsa vidare. logga in på nytt.
es ist ein fehler passiert. fehler 000: seite nicht da. die seite wurde nicht gefunden. die angeforderte datei ist nicht verfügbar. die seite ist zurzeit nicht verfügbar. der zugriff wurde verweigert. interner fehler im server. der dienst ist nicht erreichbar. bitte versuchen sie es noch einmal. versuchen sie es später erneut. ihre sitzung ist abgelaufen. bitte melden sie sich erneut an. zu viele anfragen.
"""
SCRIPTS = """
javascript is required. javascript must be enabled. this site needs javascript to work. this app works only with scripts turned on. please turn on javascript in the browser. enable javascript to see this page. to view the entry, please enable javascript. you have to enable scripts to run it. scripts are turned off. scripting is disabled in this browser. your browser has javascript disabled; turn it on, then continue. the viewer needs scripting to be allowed. your browser does not run scripts. <noscript>scripting is needed here.</noscript>
checking whether your browser runs scripts. checking the browser, this may take some seconds. cookies and javascript must be enabled to go on. please allow cookies and scripts to continue.
sidan kräver javascript. ordboken kräver att javascript är på. slå på javascript i din webbläsare. slå på skript i webbläsaren och ladda sedan om sidan. aktivera javascript för att läsa. aktivera kakor och javascript om du vill fortsätta. javascript är avstängt i webbläsaren. alla skript är nu avstängda. vi ser att du har stängt av skript. utan skript kan sidan inte visas. vi kan inte visa sidan utan dem. din webbläsare kör inte skript och därför kan inget visas. webbläsaren stöder inte javascript. skript måste tillåtas här för att du ska kunna bläddra. tillåt skript.
diese seite braucht javascript. das wörterbuch benötigt javascript. um das wörterbuch nutzen zu können, aktivieren sie bitte javascript im browser. javascript ist ausgeschaltet. skripte sind deaktiviert. bitte schalten sie skripte ein und laden sie die seite neu. ihr browser kann keine skripte ausführen.
"""
#: Words that programs leave where a value is missing, and what is written where a text is to be put in.
EMPTY_WORDS = "undefined nan tbd tba null none [object object] nil n/a"
FILL_INS = """
[insert text here] [insert a definition here] [insert name here] [add text here] [your text here] [enter text] [name here] [write definition] [description here] [insert definition]
[infoga text] [infoga en förklaring här] [skriv text här] [fyll i text] [ange ordet] [namn här] [namnet på ordet] [text kommer här] [lägg in definition här]
<enter your text> <write your text here> <your name here> <skriv din text här> <ange text> <ange ordets klass> <namn> <infoga text här>
[text hier einfügen] [hier text einfügen] [definition einfügen] [namen eintragen] <text eingeben>
(to be filled in later) (to be added) (fill in) (fyll i senare) (ska fyllas i) (förklaring saknas ännu – fyll i den) (text saknas – fyll i) (kompletteras) (wird ergänzt) (bitte ausfüllen)
…fylls i senare… …text följer… …to be continued… todo: write the text todo: skriv texten todo: add definition todo: lägg till fixme: text saknas
"""
#: Marks that open and close a slot.
SLOT_MARKS = [
    ("{{", "}}"), ("{{ ", " }}"), ("{{{", "}}}"), ("{", "}"), ("{% ", " %}"), ("<%= ", " %>"), ("<% ", " %>"), ("%(", ")s"), ("${", "}"), ("#{", "}"), ("__", "__"), ("@@", "@@"), ("$", "$"), ("%", "%"),
    ("[[", "]]"), ("[", "]"), ("<", ">"), ("«", "»"), ("##", "##"), ("<<", ">>"),
]
#: Sentences that speak about slots, and sentences that slots stand in; ¤ marks the slot.
MENTIONS = """
the template has ¤ in the place of the word. in the template, ¤ is written where the headword belongs; the export puts in the word, and a reviewer replaces the rest before printing.
the label ¤ is a value that the source counts. column two has the label ¤. the string ¤ occurs in the source 00 times. the value ¤ in the column is counted. it occurs 00 times in the source.
the field ¤ means that a row is waiting. in older records a field ¤ shows that review is waiting for them. there are 00 such rows.
the characters ¤ are an example of how a writer marks fields. the example shows the characters ¤; see number 00 too. the syntax ¤ marks a field.
the line ¤ belongs to the configuration. the configuration holds the line ¤ on purpose; nobody should fill it in by hand. it is intended so.
the placeholder ¤ stands for a name and is described in the manual. as the manual says, ¤ is the name of a variable. the documentation of ¤.
i mallen skriver man ¤ för uppslagsordet. mallen har ¤ på uppslagsordets plats, och granskaren byter ut tecknen före tryckningen. exporten ersätter ¤ i varje rad.
fältet ¤ betyder att en rad väntar. i äldre poster finns fältet ¤, och det betyder att granskningen väntar; 00 sådana finns.
tecknen ¤ visar hur man anger fält. exemplet visar tecknen ¤, så anger skrivaren ett fält; jämför nummer 00. raden ¤ är med avsikt kvar i konfigurationen och fylls inte i för hand. den är avsiktlig.
etiketten ¤ är ett värde som källan har. i kolumn två står etiketten ¤; den förekommer 00 gånger i källan. värdet ¤ förekommer 00 gånger. platshållaren ¤ förklaras i handledningen. exporten byter ut platshållaren.
die vorlage hat ¤ an der stelle des stichworts. in der vorlage steht ¤ für das wort, und der export setzt es in jede zeile ein. das feld ¤ bedeutet, dass eine zeile noch auf die prüfung wartet. ältere einträge haben das feld.
das beispiel zeigt die zeichen ¤, so gibt man ein feld an. die zeile ¤ ist in der konfiguration beabsichtigt. der platzhalter ¤ wird im handbuch beschrieben. das etikett ¤ kommt 00 mal in der quelle vor. die spalte zwei hat den wert.
"""
FRAMES = """
dear ¤, your entry was changed on ¤. dear ¤, thank you. hello ¤, we have changed your entry. yours, ¤.
the form is ¤. the plural is ¤. the word ¤ is inflected as ¤. see also ¤. see ¤ for more. the page ¤ was read by ¤. more on ¤.
hej ¤, din artikel ändrades ¤. bästa ¤, tack. hälsningar, ¤. ordets form är ¤. pluralen är ¤. ordet ¤ böjs som ¤. se ¤. se även ¤ för mer. sidan ¤ granskades av ¤. artikeln på sidan har granskats. mer om ¤.
liebe ¤, lieber ¤, der eintrag wurde geändert. die form lautet ¤. der plural lautet ¤. siehe auch ¤. die seite ¤ wurde von ¤ geprüft. mehr zu ¤.
¤, v.
¤, s.
¤, adj.
¤ – ¤
<li>¤</li>
"""
#: Sentences that speak about notices and filler, and count as prose (TALK_SHARE).
TALK = """
while fetching the pages, the server returned the status 000 bad request twice, and once 000 service unavailable, before the file was in the cache. the download returned an error before it was filled. the crawler got 000 not found for 00 pages.
the page asks its readers to enable javascript, so we made a copy of it without scripts. since the review needs javascript, the offline version was made another way. the viewer asks the user to turn on scripts, which the copy doesn't need.
the message internal server error is mentioned in 00 lines of the log. the log of the last run mentions the error 00 times. an error message is quoted in the report. the article explains the message page not found. the words lorem ipsum are mentioned as an example of filler.
vid hämtningen svarade servern två gånger med 000 bad gateway innan sidan fanns i cachen. felmeddelandet nämns 00 gånger i loggen. meddelandet internal server error nämns i loggrader från körningen. i rapporten citeras felmeddelandet. artikeln förklarar meddelandet sidan hittades inte.
sidan ber läsaren att aktivera javascript, och därför gjordes en kopia utan skript. granskningen kräver javascript, så kopian gjordes på annat sätt. orden lorem ipsum nämns som exempel på utfyllnad.
beim abruf antwortete der server zweimal mit 000 service unavailable, bevor die seite im zwischenspeicher lag. die fehlermeldung wird im protokoll 00 mal erwähnt. die meldung internal server error kommt in den zeilen des protokolls vor. die seite bittet den leser, javascript einzuschalten, deshalb wurde die kopie ohne skripte erstellt. der artikel erklärt die meldung seite nicht gefunden.
"""
#: Names of the fields of a dictionary's entry.
LABELS = "name word headword lemma heading title class text form notation definition ord uppslagsord klass ordklass böjning form förklaring wort stichwort wortart beugung erklärung"
# -----------------------------------------------------------------------------------------

BUCKETS = 1 << 18
ORDER, SHAPE_ORDER = 4, 5
#: Grams in a window, and the mean log ratio that makes it residue; shorter for slots of words.
WINDOW, SLOT_WINDOW = 12, 5
SURE, SLOT_SURE = 1.0, 3.0
#: Grams in the windows of slots' shapes, the log ratio of a whole window that makes it a slot, and of a gram that opens or closes one.
SHAPE_WINDOWS, SHAPE_SURE, SHAPE_END = (2, 3, 4, 6, 8, 10, 12, 14, 17, 20), 8.0, 2.5
#: Residue must cover this share of a sentence, and so many characters of it.
COVERAGE, LEAST_CHARS, LEAST_SHORT = 0.6, 8, 6
#: A sentence that residue covers in part, or that is shorter than a window, is residue if its grams have this mean log ratio: prose lies far below.
SENTENCE_SURE, SHORT_SURE = -1.2, 0.8
#: Times the phrases and what they found refit the models.
ROUNDS = 2
#: A gram that neither slots nor prose have is this much less likely in a slot (log).
RARE = -5.0
#: A gram's share of natural prose is taken as this at least: what is merely rare isn't residue.
LEAST_SHARE = 5e-6
#: Sentences that speak about notices and slots weigh as much as this share of all prose.
TALK_SHARE = 0.25


def _fold_table() -> np.ndarray:
    t = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x2000):
        low = chr(cp).lower()
        if len(low) == 1:
            t[cp] = ord(low)
    t[0x30:0x3A] = 0x30
    t[[0x09, 0x0D, 0xA0]] = 0x20
    return t


def _shape_table() -> np.ndarray:
    t = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x2000):
        c = chr(cp)
        if c.isalpha():
            t[cp] = ord("A") if c.isupper() else ord("a")
    t[0x2000:][[chr(c).isalpha() for c in range(0x2000, 0x3000)] + [False] * (0x110000 - 0x3000)] = ord("a")
    t[0x30:0x3A] = 0x30
    t[[0x09, 0x0D, 0xA0]] = 0x20
    return t


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _TABLES:
        _TABLES[name] = _fold_table() if name == "fold" else _shape_table()
    return _TABLES[name]


def _hashes(cp: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the gram that starts at each code point; the last ones run into line feeds."""
    padded = np.concatenate([cp, np.full(order - 1, 10, cp.dtype)]).astype(np.uint64)
    h = np.zeros(len(cp), np.uint64)
    for k in range(order):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (padded[k : k + len(cp)] + np.uint64(0x632BE59BD9B4E019))
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _lines(lines: list[str], table: str = "fold") -> np.ndarray:
    """Gram counts of lines, each between line feeds."""
    return np.bincount(_hashes(_table(table)[_codes("\n" + "\n".join(lines) + "\n")], ORDER), minlength=BUCKETS).astype(float)


def _fill_lines() -> list[str]:
    """Filler: words and marks repeated, keys side by side, Latin words in any order, sentences that stand in for content."""
    words, keys, latin = FILL_WORDS.split(), KEY_ROWS.split(), LATIN.split()
    lines = [f"{w} {w} {w} {w}, {w}, {w}. {w}" for w in words] + words * 8 + [m * k for m in FILL_MARKS.split() for k in (4, 8)]
    lines += [" ".join([m * k] * 4) for m in FILL_MARKS.split() for k in (4, 8)]
    lines += [f"{a}{b} {a} {b}" for a in keys for b in keys]
    rng = np.random.default_rng(11)
    lines += [" ".join(latin[i] for i in rng.permutation(len(latin))) + "." for _ in range(6)]
    return lines + STANDINS.strip().split("\n")


def _notice_lines() -> list[str]:
    """Notices: what servers and viewers say, with the status phrases of the web's standard as text, page and record."""
    lines = FAILURES.strip().split("\n") + SCRIPTS.strip().split("\n")
    for status in http.HTTPStatus:
        if status >= 400:
            phrase = status.phrase.lower()
            lines.append(f"error {int(status)}: {phrase} <title>{int(status)} {phrase}</title></head><body><h1>{phrase}</h1></body></html>")
            lines += [f"{int(status)} {phrase}"] * 4
            lines.append(f'{{"error": "{phrase.replace(" ", "_")}", "status": {int(status)}, "request_id": "0a0b"}}')
    return lines


def _slot_lines() -> list[str]:
    """Slots of words: a missing value alone, in a list and in a sentence; invitations to fill in."""
    words = EMPTY_WORDS.replace("[object object]", "[object\0object]").split()
    words = [w.replace("\0", " ") for w in words]
    shapes = ("{}", "{}, v.", "{}, s.", "{}, adj.", "see {} for", "se {} för", "is {}.", "är {}.", ", {}, ", "dear {},", "hej {},", "av {}.", "by {}.", ": {}")
    # these are words of other texts too: only where nothing else is said
    alone = {"null", "none", "nil", "n/a", "tba"}
    return [f.format(w) for w in words for f in (shapes[1:4] if w in alone else shapes)] + FILL_INS.strip().split("\n")


def _slot_shapes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots' shapes, marks around names: gram counts, and the kinds of marks (a bit each) that a gram opens or closes."""
    out, opens, closes = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for kind, (before, after) in enumerate(SLOT_MARKS):
        names = [x * k for x in "aA" for k in range(4, 14)] + [x * j + "_" + y for x in "aA" for j in (4, 5, 6) for y in (x * 2, x * 4, "0")]
        if before in "[<":
            # what is to be filled in, said in words
            names += ["Aaaa" + "a" * i + " " + "a" * j + " " + "a" * k for i in range(4) for j in (2, 3, 4, 10) for k in range(4, 13)]
        if before == "{% ":
            names += ["aaa a aa aaaaaaa", "aa aaaa"]
        for name in names:
            h = _hashes(_table("shape")[_codes(before + name + after)], SHAPE_ORDER)
            h = h[: max(len(h) - SHAPE_ORDER + 1, 0)]
            np.add.at(out, h, 1)
            if len(h):
                opens[h[0]] |= 1 << kind
                closes[h[-1]] |= 1 << kind
    return out, opens, closes


def _log_share(counts: np.ndarray, floor: float) -> np.ndarray:
    return np.log((counts + floor) / (counts.sum() + floor * BUCKETS)).astype(np.float32)


@dataclass
class ResidueModel:
    """Log ratios of filler, notices and slots to natural prose, by gram bucket."""

    ratio: np.ndarray  # 3 x BUCKETS over folded characters
    shape: np.ndarray  # BUCKETS over shapes
    opens: np.ndarray  # BUCKETS: kinds of marks that a gram of shapes opens, as bits
    closes: np.ndarray
    mention: np.ndarray  # BUCKETS: sentences about slots against sentences with slots


def _model(natural: np.ndarray, shapes: np.ndarray, found: np.ndarray | None, without: str = "") -> ResidueModel:
    """The models from gram counts; `without` leaves out the phrases of one kind (`scripts`, `failures`, `standins`), to see how well the others find it."""
    left_out = {"scripts": SCRIPTS, "failures": FAILURES, "standins": STANDINS}.get(without, "").strip().split("\n")
    seeds = [_lines([x for x in f() if x not in left_out]) for f in (_fill_lines, _notice_lines, _slot_lines)]
    if found is not None:
        # what was found weighs as much as the phrases at most; by logarithms, so that kinds of
        # which more data hold ever more variants don't push out those that are always written alike
        found = np.log1p(found)
        seeds[:2] = [s + f * min(1.0, s.sum() / max(f.sum(), 1)) for s, f in zip(seeds[:2], found)]
    least = np.float32(np.log(LEAST_SHARE))
    talk = _lines((TALK + MENTIONS).strip().split("\n"))
    base = np.maximum(_log_share(natural + TALK_SHARE * natural.sum() / talk.sum() * talk, 0.5), least)
    ratio = np.stack([_log_share(s, 0.005) for s in seeds]) - base
    slots, opens, closes = _slot_shapes()
    shape_base = np.maximum(_log_share(shapes, 0.5), least)
    # slots are few words and marks: smoothed so little that what they don't have counts against them
    ratio[2] = np.maximum(np.log(np.maximum(seeds[2], 1e-9) / seeds[2].sum()), least + RARE) - base
    shape = np.maximum(np.log(np.maximum(slots, 1e-9) / slots.sum()), least + RARE) - shape_base
    # letters alone, whatever their case, open and close nothing
    for run in ("aaaaa", "AAAAA", "Aaaaa", "aaaa ", " aaaa", " AAAA", "AAAA ", " Aaaa"):
        shape[_hashes(_codes(run), SHAPE_ORDER)[0]] = min(shape[_hashes(_codes(run), SHAPE_ORDER)[0]], 0.0)
    about, frame = _lines(MENTIONS.strip().split("\n")), _lines(FRAMES.strip().split("\n") + [f"{x}: ¤" for x in LABELS.split()])
    mention = np.log((about / about.sum() + 1e-4) / (frame / frame.sum() + 1e-4)).astype(np.float32)
    # runs of digits stand anywhere, and runs of one letter are noise, not filler
    for run, score in (("0000", 0.0), ("xxxx", RARE)):
        ratio[:, _hashes(_codes(run), ORDER)[0]] = score
    return ResidueModel(ratio.astype(np.float32), shape.astype(np.float32), opens, closes, mention)


def _spread(score: np.ndarray, width: int, sure: float) -> np.ndarray:
    """Characters under any window of `width` grams whose mean score is at least `sure`."""
    n = len(score)
    if n < width:
        return np.zeros(n, bool)
    total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    hot = (total[width:] - total[:-width]) >= sure * width
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(hot)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def _widen(at: np.ndarray, width: int) -> np.ndarray:
    """Also the characters that the marked grams reach over."""
    edge = np.zeros(len(at) + 1, np.int32)
    k = np.flatnonzero(at)
    np.add.at(edge, k, 1)
    np.add.at(edge, np.minimum(k + width, len(at)), -1)
    return np.cumsum(edge[: len(at)]) > 0


class Scored:
    """The sentences of a batch of texts, each with its residue."""

    def __init__(self, texts: pa.Array, model: ResidueModel) -> None:
        whole = texts.cast(pa.large_string()).fill_null("")
        cp, offsets = _points(whole)
        n = len(whole)
        # every text begins after a line feed of its own
        raw = np.full(len(cp) + n + 1, 10, np.uint32)
        row_of = np.repeat(np.arange(n), np.diff(offsets))
        raw[np.arange(len(cp)) + row_of + 1] = cp
        self.row = np.searchsorted(offsets[1:] + np.arange(1, n + 1), np.arange(len(raw)), side="right")
        self.row = np.minimum(self.row, max(n - 1, 0))
        self.folded, shaped = _table("fold")[raw], _table("shape")[raw]
        self.grams, self.shapes = _hashes(self.folded, ORDER), _hashes(shaped, SHAPE_ORDER)
        per = model.ratio[:, self.grams]
        fill = _spread(per[0], WINDOW, SURE)
        note = _spread(per[1], WINDOW, SURE)
        drawn = model.shape[self.shapes]
        marks = np.zeros(len(drawn), bool)
        for width in SHAPE_WINDOWS:
            marks |= _spread(drawn, width, SHAPE_SURE / width)
        words = _spread(per[2], SLOT_WINDOW, SLOT_SURE)
        slot = _widen(marks, SHAPE_ORDER) | _widen(words, ORDER)
        # sentences end at line feeds and at full stops before a blank
        nxt = np.append(raw[1:], 10)
        end = (raw == 10) | (np.isin(raw, (0x2E, 0x21, 0x3F)) & ((nxt == 0x20) | (nxt == 10)))
        begin = np.concatenate([[True], end[:-1]])
        self.sentence = np.cumsum(begin) - 1
        m = int(self.sentence[-1]) + 1 if len(raw) else 0
        solid = (self.folded != 0x20) & (self.folded != 10)
        size = lambda mask: np.bincount(self.sentence[mask & solid], minlength=m)
        length = np.maximum(size(solid), 1)
        self.fill, self.note, self.slot = size(fill), size(note), size(slot & ~(note & ~slot))
        covered = np.maximum(self.fill, self.note)
        self.covered = (covered >= COVERAGE * length) & (np.maximum(covered, 1) >= np.minimum(LEAST_CHARS, length)) & (covered >= 3)
        grams = np.maximum(np.bincount(self.sentence, minlength=m), 1)
        for k, part in enumerate((self.fill, self.note)):
            mean = np.bincount(self.sentence, weights=per[k], minlength=m) / grams
            self.covered |= (part >= WINDOW) & (mean >= SENTENCE_SURE)
            # shorter than a window
            self.covered |= (grams <= WINDOW + 1) & (length >= LEAST_SHORT) & (mean >= SHORT_SURE)
        # around a slot, what the sentence says
        about = np.bincount(self.sentence[solid & ~slot], weights=model.mention[self.grams][solid & ~slot], minlength=m)
        # a slot has an opening and an end of one kind, or is one of the known words
        ends = np.zeros((2, m), np.int64)
        hot = np.flatnonzero(marks & (drawn >= SHAPE_END))
        for k, kinds in enumerate((model.opens, model.closes)):
            np.bitwise_or.at(ends[k], self.sentence[hot], kinds[self.shapes[hot]])
        closed = (ends[0] & ends[1]) > 0
        worded = np.bincount(self.sentence[words], minlength=m) > 0
        self.held = (closed | worded) & (self.slot >= 3) & ((about <= 0) | (length - self.slot < LEAST_CHARS))
        self.first = np.searchsorted(self.sentence, np.arange(m))
        self.sentence_row = self.row[np.minimum(self.first, max(len(raw) - 1, 0))] if m else np.zeros(0, np.int64)
        self.n = n

    def residue(self) -> np.ndarray:
        """Whether each text has residue in the place of content."""
        out = np.zeros(self.n, bool)
        out[self.sentence_row[self.covered | self.held]] = True
        return out


def _counts(documents: DataFrame, column: str, model: ResidueModel | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram counts over the rows of `documents`: natural prose, its shapes, and filler and notices found by `model`.

    Without a model everything counts as natural. At most 4 * BUCKETS rows reach the driver.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        total = np.zeros((4, BUCKETS), np.int64)
        for batch in batches:
            for part in _parts(batch.column(0)):
                if shared.value is None:
                    cp = _codes("\n".join(["", *(x for x in part.to_pylist() if x), ""]))
                    total[0] += np.bincount(_hashes(_table("fold")[cp], ORDER), minlength=BUCKETS)
                    total[1] += np.bincount(_hashes(_table("shape")[cp], SHAPE_ORDER), minlength=BUCKETS)
                    continue
                s = Scored(part, shared.value)
                kind = np.zeros(len(s.covered), np.int64)
                kind[s.covered] = np.where(s.fill[s.covered] >= s.note[s.covered], 2, 3)
                kind[s.held] = 4
                of = kind[s.sentence]
                total[0] += np.bincount(s.grams[of == 0], minlength=BUCKETS)
                total[1] += np.bincount(s.shapes[of == 0], minlength=BUCKETS)
                total[2] += np.bincount(s.grams[of == 2], minlength=BUCKETS)
                total[3] += np.bincount(s.grams[of == 3], minlength=BUCKETS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k * BUCKETS + b), pa.array(total[k, b])], names=["at", "n"])

    rows = documents.select(column).mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * BUCKETS)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    out = out.reshape(4, BUCKETS)
    return out[0], out[1], out[2:]


def _parts(texts: pa.Array, size: int = 4_000_000):
    start = total = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        total += n or 0
        if total > size:
            yield texts.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(texts):
        yield texts.slice(start)


def distinct_sentences(documents: DataFrame, column: str) -> DataFrame:
    """The sentences of all texts, each once; digits count as equal, so a number in a notice doesn't make another of it."""
    parts = F.split(F.translate(column, "123456789", "000000000"), r"(?<=[.!?])(?=[ \n])|\n")
    return documents.select(F.explode(parts).alias(column)).filter(F.trim(column) != "").distinct()


def fit_residue(documents: DataFrame, column: str, without: str = "") -> ResidueModel:
    """The models, from the distinct sentences of all documents; found filler and notices refit them ROUNDS times.

    `without` leaves out the phrases of one kind, to measure how far the models reach.
    """
    sentences = cut(distinct_sentences(documents, column), "sentences")
    natural, shapes, found = _counts(sentences, column, None)
    model = _model(natural, shapes, None, without)
    for _ in range(ROUNDS):
        natural, shapes, found = _counts(sentences, column, model)
        model = _model(natural, shapes, found, without)
    discard(sentences)
    return model


def has_residue(documents: DataFrame, column: str, model: ResidueModel) -> Column:
    """Whether a text has residue in the place of content; false for null, empty and blank texts.

    Whole texts are scored, whatever their length.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def judge(texts: pa.Array) -> pa.Array:
        found = [Scored(part, shared.value).residue() for part in _parts(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return judge(column)
