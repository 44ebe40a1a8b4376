"""Problem 3: pages that hold template residue, filler, an error message or a demand for scripts.

Everything is built from JVM expressions over the whole html text.  Scripts,
styles, comments, ``noscript`` and code samples are cut out; what a reader sees
is split into sentences.  A placeholder is found by the grammar of its
delimiters anywhere in the visible text; one in a sentence that teaches
templates, or right after such a sentence, is an example, and so are all on a
page of mostly examples.  Filler, error messages and demands
for scripts are judged by density: they must make up at least half of the
letters that say anything, navigation, footers, headings of one or two words
and stock phrases such as "try again later" left aside.  Sentences that talk
about such things ("the guide shows how to ...") count as content.

Defined results: null html and html without visible text and without a notice
for browsers without scripts is no case; ``has_html`` is not looked at; extra
columns are ignored; repeated rows give one result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.plans.stages import let, once

# Names, and what may stand between two delimiters up to the closing one; possessive, so that long texts cost one pass.
_N = r"[A-Za-z_][\w.\- ]*+"
#: One grammar for each kind of delimiter, read up to the matching closing one.
PLACEHOLDERS = (
    r"\{\{\{?[~\-]?\s*[#/&^>!]?\s*[\p{L}_$\"'@][^{}\n]*+\}\}",
    r"\$\{\s*[A-Za-z_][^{}\n]*+\}",
    r"(?<![A-Za-z0-9])#\{\s*[A-Za-z_][^{}\n]*+\}",
    r"\$\[" + _N + r"\]",
    r"\[\[\s*" + _N + r"\]\]",
    r"\{%[-+]?\s*[a-z](?:[^%{\n]|%(?!\})|\{(?!%))*+%\}",
    r"<%[=\-#]?(?:[^%<\n]|%(?!>)|<(?!%))++%>",
    r"<\?(?:php|=)(?:[^?<\n]|\?(?!>)|<(?!\?))*+\?>",
    r"%%[A-Za-z][\w.]*+%%",
    r"@@[A-Za-z][\w.]*+@@",
    r"\*\s*\|\s*[A-Z][A-Z0-9_.:]*+\s*\|\s*\*",
    r"(?<![A-Za-z0-9_])__[A-Z](?:[A-Z0-9.]|_(?!_))*+__(?![A-Za-z0-9_])",
    r"%\([A-Za-z_][\w.]*+\)[sdif]",
    r"(?<![{$#\w])\{(?:[0-9]{1,2}|[A-Za-z_]\w*+(?:\.\w++)*+(?:\[[\w\"']++\])?)\}(?!\})",
    r"\[(?:(?i:your|insert|enter|add|put|type)\s)[^\]\[\n]++\]",
    r"<[A-Za-z][A-Za-z ]* (?:goes )?here>",
)
PLACEHOLDER = "|".join(PLACEHOLDERS)

# Words of the usual filler text.
LOREM = (
    "lorem|ipsum|dolor|dolore|amet|consectetur|adipiscing|adipisicing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|enim|minim|veniam|quis|"
    "nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|"
    "pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum|sit|ut|et|ad|ex|ea|id|est|eu|qui"
)
FILLER = (
    r"(?i)\b(?:sample|dummy|placeholder|demo) (?:text|copy|paragraph|content)|\bplaceholder$|(?:\btext[ .,]+){3}|\bdouble-click (?:the|this) (?:box|text)|"
    r"\byour (?:own )?(?:content|text|description|product|headline|story|words?)\b.{0,20}\b(?:here|goes|comes|in this (?:box|area)|soon)\b|"
    r"\b(?:add|write|describe|enter) your .{1,30} in this (?:box|area|place)\b|\b(?:headline|title|subtitle|text|content|copy|name) goes here|"
    r"\b(?:hier steht|ihr text hier|platzhaltertexte?\b|blindtexte?\b)|\b(?:votre texte ici|texte (?:de remplissage|ici))|\b(?:aquí|aqui) (?:tu|su) (?:contenido|texto)|"
    r"\bto write your own words\b|\bto be replaced\.?$|\bcontent (?:comes|coming) (?:here )?soon\b"
)
_THING = (
    r"(?:page|site|website|file|document|resource|server|service|host|address|url|request|database|web ?space|account|application|origin|gateway|"
    r"connection|access|link|content|domain|folder|/\S+)"
)
_FAULT = (
    r"(?:could|can) ?not be (?:found|displayed|reached|opened|loaded|processed|shown)|(?:was|is|were) not (?:found|available|on this server)|"
    r"(?:does|did) not (?:exist|respond)|(?:is )?no longer (?:here|available|exists?)|(?:has|have) been (?:removed|deleted|suspended|disabled|taken offline|blocked|moved|closed)|"
    r"has moved|was (?:refused|removed|denied|blocked|deleted|suspended|switched off|disabled)|ran out of memory|(?:failed|met)(?: with)? an? (?:internal )?(?:fault|error)|"
    r"timed out|took (?:too long|longer than)|is (?:temporarily |currently )?(?:out of (?:service|reach|order)|unavailable|offline|down)|(?:gave|sent) no valid answer|"
    r"no database answers"
)
#: A thing and its fault; looked for only in sentences that hold a fault at all.
ERROR_SENTENCE = (
    rf"(?i)(?:^|\b(?:the|this|your|our|that)\b|/)[^.!?]{{0,60}}?{_THING}\b[^!?]{{0,60}}?\b(?:{_FAULT})\b|^/\S+ (?:{_FAULT})\b|^[^a-z]*(?:{_THING} )?(?:{_FAULT})\b|"
    # whatever the thing is, if the sentence says nothing else
    r"^(?:the|this|that|your|our) (?:[\w'-]+ ){1,4}?(?:(?:is )?no longer (?:available|here|exists?)|(?:could|can) ?not be found|was not found|does not exist)\b[^.!?]{0,30}[.!]?$"
)
FAULT = rf"(?i)\b(?:{_FAULT})\b"
ERROR_LINE = (
    r"(?i)^[^\p{L}\p{N}]*(?:(?:http|status|error|code|fehler|erreur)[^\p{L}\p{N}]{0,3}[1-5]\d\d|[45]\d\d)\b.{0,60}$|^(?:error|warning|problem loading page|oops|sorry)[^\p{L}\p{N}]*$|"
    r"^(?:(?:(?:page|file|seite|site) )?not (?:found|available)|bad gateway|gateway time-?out|(?:internal )?server error|service unavailable|forbidden|"
    r"access (?:denied|forbidden)|request blocked|(?:account|site|page|service) (?:disabled|suspended))[^\p{L}\p{N}]*$|"
    r"\bsomething (?:broke|went wrong)\b|\bwe (?:could|can) ?not find|\byou do not have (?:the )?(?:rights?|permissions?) to|^(?:fatal|uncaught|php)\b ?\w* ?(?:fault|error)|^\w+ fault: |"
    r"^traceback\b|^warning: \w+\(|\bstack trace\b|\binternal server error|\bmethod \w+ used on nothing|"
    r"\bla (?:página|pagina) \S+ no existe\b|\b(?:página|pagina) no encontrada\b|\best introuvable\b|\bn'existe (?:pas|plus)|\bnicht gefunden\b|\bgibt es nicht mehr|\bnicht verfügbar\b"
)
_SCRIPT = r"(?:java ?script|js|scripts?|scripting|client-side scripts?)\b"
SCRIPTS = (
    rf"(?i)\b(?:enable|activate|allow|permit|unblock|turn(?:ing)? on|switch(?:ing)? on)\s+(?:\w+\s+){{0,2}}?{_SCRIPT}|"
    rf"\b{_SCRIPT}[^.]{{0,60}}\b(?:must be (?:allowed|enabled|on|turned on|switched on)|(?:is|are) (?:required|needed|disabled|off|switched off|turned off|not (?:enabled|supported|running)))|"
    rf"\b(?:needs?|requires?|wants?)\s+(?:\w+\s+){{0,3}}?{_SCRIPT}|\b(?:does not|doesn't|cannot) (?:run|support|execute) {_SCRIPT}|(?:browser )?supports? {_SCRIPT}|"
    r"(?:aktivieren|einschalten|erlauben) sie (?:bitte )?javascript\b|\bjavascript (?:zu )?(?:aktivieren|einschalten)|activer (?:les scripts|javascript)\b|"
    r"(?:activa|active|activar|habilite|habilita|habilitar) javascript\b|(?:ative|habilite)(?: o)? javascript\b"
)
_LESSON = r"(?:guide|tutorial|library|lesson|lecture|class|article|course|workshop|chapter|book|museum|exhibit|exhibition|section|post)"
#: A sentence that talks about such things instead of being one: it says how something is done, or what a lesson or a quoted text says.
TALK = (
    rf"(?i)\bhow (?:to|you|we|one)\b|\bstep by step\b|\b{_LESSON}\b[^.!?]{{0,80}}?\b(?:shows?|explains?|teach(?:es)?|tells?|describes?|covers?|looks? at|discuss(?:es)?|compares?|is about|introduces?)\b|"
    r"\b(?:message|phrase|sentence|words?|text|heading)s? [\"“„«]|[\"”»] (?:means?|says|appears|is shown)\b"
)
#: A sentence that teaches templates; a spot in it or right after it is an example.
TEACH = (
    rf"{TALK}|\b(?:syntax|placeholders?|templat(?:e|es|ing)|variables?|expressions?|interpolat\w+|(?:is|are|gets?|will be) (?:replaced|substituted|filled in) (?:by|with)|stands? for|renders?|"
    r"for example|code samples?)\b|\be\.g\."
)
#: From so many examples on, a page teaches templates if they outnumber the other spots.
EXAMPLES = 3
#: Stock phrases that say nothing about the page; they count neither for nor against.
STOCK = (
    r"(?i)^[^\p{L}\p{N}]*+(?:(?:please )?(?:try|retry|load|reload|come back)\b.{0,60}|retry in .{0,30}|go back to .{0,40}|check the spelling.{0,40}|contact .{0,30}|"
    r"reference\b.{0,20}|incident\b.{0,30}|ray\b.{0,20}|code \w+|ref \w+|(?:nginx|httpd|edge|apache|iis|openresty)[^\p{L}\p{N}]*[\d.]*|just a moment.{0,20}|one moment.{0,20}|"
    r"loading.{0,10}|hmm|oops|sorry|unfortunately|(?:\w+ ){0,2}cannot load|allow them and .{0,40}|enable them and .{0,40}|[\w-]+(?:\.[\w-]+)+)?[^\p{L}\p{N}]*+$"
)

KINDS = ("placeholder", "filler", "error", "scripts")
#: Every match of a pattern of a kind holds one of these as a whole word (a run of letters and digits) of the text that it is matched on;
#: a page without any is not looked at more closely.
TRIGGERS = {
    "filler": (
        "sample", "dummy", "placeholder", "demo", "text", "double", "here", "goes", "comes", "soon", "box", "area", "place", "hier", "platzhaltertext", "platzhaltertexte", "blindtext",
        "blindtexte", "texte", "aquí", "aqui", "words", "replaced",
    ),
    "error": (
        "not", "cannot", "couldnot", "longer", "been", "refused", "removed", "denied", "blocked", "deleted", "suspended", "switched", "disabled", "memory", "fault", "error",
        "timed", "took", "out", "unavailable", "offline", "down", "valid", "database", "warning", "problem", "oops", "sorry", "gateway", "forbidden", "broke", "wrong", "fatal", "uncaught",
        "php", "traceback", "stack", "internal", "nothing", "existe", "encontrada", "introuvable", "gefunden", "gibt", "verfügbar",
    ),
    "scripts": ("javascript", "java", "js", "script", "scripts", "scripting"),
}
NO_WORD = r"[^\p{L}\p{N}]+"
#: Or one of these: a frequent word only with the one before it, and the code of an error where a sentence may begin.
MOVED = "has moved"
CODE = r"(?:\A|[\n.!?])[^\p{L}\p{N}]*+(?:(?:http|status|error|code|fehler|erreur)[^\p{L}\p{N}]{0,3}[1-5]\d\d|[45]\d\d)\b"
#: Placeholders need one of these in the html without its tags; the first, quicker pattern looks at the tags too.
MARKS = (r"[{\[%@_*&]|<[%?]", r"[{\[]|%[%(]|@@|__|<[%?]|&(?:lt|lcub|#)|\*(?:\s|&nbsp;)*+\|")
#: A heading of one or two words and up to so many letters counts only if it is residue itself.
SHORT = 30
#: Scripts without blanks between words; their sentences are never headings by the number of words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"

_BLOCK = r"</?(?:p|div|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|td|th|section|article|main|aside|header|footer|nav|center|hr|br|body|html|head|title|form|blockquote|figure)\b[^>]*>"


def _cut(col: Column, names: str) -> Column:
    """Without the elements of these names; one that never ends goes to the end of the text."""
    return F.regexp_replace(F.regexp_replace(col, rf"(?is)<({names})\b[^>]*>.*?</\1\s*>", " "), rf"(?is)<(?:{names})\b.*$", " ")


def _text(col: Column) -> Column:
    """Lines of visible text of a piece of html."""
    t = F.regexp_replace(F.regexp_replace(col, r"\s+", " "), "(?i)" + _BLOCK, "\n")
    t = F.regexp_replace(t, r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>", "")
    return let(t, lambda x: F.when(x.contains("&"), _decoded(x)).otherwise(x))


def _decoded(t: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&#123;|&lcub;", "{"), ("&#125;|&rcub;", "}"), ("&amp;", "&")):
        t = F.regexp_replace(t, name, ch)
    return t


def _sentences(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, r"\n+|(?<=[.!?])\s+(?=[^a-z])"), lambda s: F.trim(s)), lambda s: s != "")


def _letters(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"[^\p{L}]", ""))


def _is_filler(s: Column) -> Column:
    words = F.filter(F.split(F.lower(s), r"[^\p{L}]+"), lambda w: w != "")
    latin = F.filter(words, lambda w: w.rlike(f"^(?:{LOREM})$"))
    return s.rlike(FILLER) | ((F.size(words) >= 3) & (F.size(latin) * 2 >= F.size(words)))


def _is_error(s: Column) -> Column:
    return (s.rlike(FAULT) & s.rlike(ERROR_SENTENCE)) | s.rlike(ERROR_LINE)


def _slots(text: Column) -> Column:
    """Of each sentence of ``text``, if it holds a spot at all: whether it holds one, and whether it is an example, taught there or right before."""

    def judged(ss: Column) -> Column:
        marks = F.transform(ss, lambda s: F.struct(s.rlike(PLACEHOLDER).alias("slot"), s.rlike(TEACH).alias("teach")))
        before = lambda ms, i: F.coalesce(F.get(ms, i - 1)["teach"] & ~F.get(ms, i - 1)["slot"], F.lit(False))
        return let(marks, lambda ms: F.transform(ms, lambda m, i: F.struct(m["slot"].alias("slot"), (m["teach"] | before(ms, i)).alias("taught"))))

    return let(text, lambda t: F.when(t.rlike(PLACEHOLDER), let(_sentences(t), judged)))


def _unfilled(slots: Column) -> Column:
    """Whether a page has a spot that isn't an example; one that the sentence split cut in two counts as none."""
    open_ = F.size(F.filter(slots, lambda x: x["slot"] & ~x["taught"]))
    taught = F.size(F.filter(slots, lambda x: x["slot"] & x["taught"]))
    return F.coalesce(slots.isNotNull() & ((open_ + taught == 0) | ((open_ > 0) & ~((taught >= EXAMPLES) & (taught > open_)))), F.lit(False))


def _unscripted(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template|svg|iframe|object)\b[^>]*>.*?</\1\s*>", " ")


def _marked(shown: Column) -> Column:
    return F.when(shown.rlike(MARKS[0]), F.regexp_replace(shown, r"</?[a-zA-Z][^>]*>|<![^>]*>", "").rlike(MARKS[1])).otherwise(F.lit(False))


def _holds(kind: str, words: Column, low: Column) -> Column:
    """Whether a lower-case text, given with its words, can be a match of a kind, or hold one."""
    listed = F.arrays_overlap(words, F.lit(list(TRIGGERS[kind])))
    if kind == "filler":
        # half of three words or more in a sentence are filler, so two such words at least
        return listed | (F.size(F.filter(words, lambda w: w.isin(LOREM.split("|")))) >= 2)
    if kind == "error":
        return listed | low.contains(MOVED) | low.rlike(CODE)
    return listed


def _triggers(words: Column, low: Column, marked: Column) -> Column:
    """Which kinds of residue a page may hold, as an array of flags in the order of KINDS, from the lower-case text that is judged and its words."""
    return F.array(*[marked if k == "placeholder" else _holds(k, words, low) for k in KINDS])


def _stage(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones that are worked out once."""
    return once(df, **columns).select(*keep, *columns)


def inspect(rows: DataFrame, html: str = "html", every: bool = False) -> DataFrame:
    """row_id with ``placeholder``, ``filler``, ``error`` and ``scripts`` (booleans) of each row with residue (or, if ``every``, with html)."""
    df = rows.where(F.col(html).isNotNull()).select("row_id", F.col(html).alias("html"))
    df = _stage(df, ["row_id"], u=_unscripted(F.col("html")))
    h = F.regexp_replace("u", r"(?is)<!--.*$|<(?:script|style|template|svg|iframe|object)\b.*$", " ")
    notice = F.array_join(F.regexp_extract_all("u", F.lit(r"(?is)<noscript\b[^>]*>(.*?)</noscript\s*>"), 1), "\n")
    df = _stage(df, ["row_id"], notice=notice, h=_cut(h, "noscript"))
    content = _text(_cut(F.regexp_replace(F.col("h"), r"(?is)<a\b[^>]*>.*?</a\s*>", " "), "title|nav|footer|button|select|option|label"))
    df = _stage(df, ["row_id", "notice"], shown=_cut(F.col("h"), "code|pre|kbd|samp|xmp|textarea|listing"), content=content)
    if every:
        df = df.select("*", F.array(*[F.lit(True)] * len(KINDS)).alias("may"))
    else:
        df = _stage(df, ["row_id", "notice", "shown", "content"], marked=_marked(F.col("shown")), low=F.lower("content"))
        df = _stage(df, ["row_id", "notice", "shown", "content", "marked", "low"], words=F.split("low", NO_WORD))
        df = _stage(df, ["row_id", "notice", "shown", "content"], may=_triggers(F.col("words"), F.col("low"), F.col("marked")))
        # a page of a bare notice is asked about it
        df = df.withColumn("may", F.transform("may", lambda x, i: x | ((i == KINDS.index("scripts")) & (F.col("notice") != ""))))
        df = df.where(F.array_contains("may", True))
    may = dict(zip(KINDS, (F.col("may")[i] for i in range(len(KINDS)))))
    judged = may["filler"] | may["error"] | may["scripts"]
    df = _stage(df, ["row_id", "may", "notice"], slots=F.when(may["placeholder"], _slots(_text(F.col("shown")))), sentences=F.when(judged, _sentences(F.col("content"))))
    df = df.select("row_id", "may", "notice", _unfilled(F.col("slots")).alias("placeholder"), "sentences")
    # of each sentence that isn't a stock phrase: its letters, and whether it is of a kind; short headings count only if they are.
    # Patterns are tried where the sentence holds a word that they need.
    sizes = F.transform(F.filter("sentences", lambda s: ~s.rlike(STOCK)), lambda s: F.struct(s.alias("s"), _letters(s).alias("n"), F.lower(s).alias("low"), F.split(F.lower(s), NO_WORD).alias("w")))
    filler = lambda x: may["filler"] & _holds("filler", x["w"], x["low"]) & _is_filler(x["s"]) & ~x["s"].rlike(TALK)
    error = lambda x: may["error"] & _holds("error", x["w"], x["low"]) & _is_error(x["s"]) & ~x["s"].rlike(TALK)
    script = lambda x: may["scripts"] & _holds("scripts", x["w"], x["low"]) & x["s"].rlike(SCRIPTS) & ~x["s"].rlike(TALK)
    short = lambda x: (x["n"] <= SHORT) & (F.size(F.split(x["s"], r"\s+")) <= 2) & ~x["s"].rlike(UNSPACED)
    said = F.transform(sizes, lambda x: F.struct(x["n"].alias("n"), filler(x).alias("f"), error(x).alias("e"), script(x).alias("j"), short(x).alias("short")))
    df = _stage(df, ["row_id", "may", "notice", "placeholder"], said=F.filter(said, lambda x: ~x["short"] | x["f"] | x["e"] | x["j"]))
    zero = F.struct(*[F.lit(0).alias(k) for k in ("n", "f", "e", "j")])
    part = lambda x, k: F.when(x[k], x["n"]).otherwise(F.lit(0))
    mass = F.aggregate("said", zero, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), *[(a[k] + part(x, k)).alias(k) for k in ("f", "e", "j")]))
    df = _stage(df, ["row_id", "may", "notice", "placeholder"], n_said=F.size("said"), m=mass)
    dense = lambda k: F.coalesce((F.col("m")[k] > 0) & (F.col("m")[k] * 2 >= F.col("m")["n"]), F.lit(False))
    asked = F.exists(_sentences(_text(F.col("notice"))), lambda s: (s.rlike(SCRIPTS) | s.rlike(r"(?i)supports? scripts|is off\b")) & ~s.rlike(TALK))
    shell = F.when(may["scripts"] & (F.col("n_said") <= 0), asked).otherwise(F.lit(False))
    out = _stage(df, ["row_id"], placeholder=F.col("placeholder"), filler=dense("f"), error=dense("e"), scripts=dense("j") | shell)
    return out if every else out.where("placeholder or filler or error or scripts")


def residue(rows: DataFrame) -> DataFrame:
    """(row_id) of the rows that hold no real page."""
    return inspect(rows).select("row_id")


def real_pages(rows: DataFrame) -> DataFrame:
    """``rows`` without those of :func:`residue`; rows without html stay."""
    return rows.join(residue(rows), "row_id", "left_anti")
