"""Pages read with a stack of open tags, as JVM expressions: each visible text with the element that holds it."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajecta.functions import text as X

# Elements that never hold anything, and those whose text isn't shown.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HIDDEN = ("style", "script", "head", "title", "meta")
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: Tokens of one inner run: lists grow inside a run and are joined once a run.
RUN = 128

_SKIPPED = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_STRAY = r"<(?![!?/A-Za-z])"
_TOKEN = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|<[^>]*+>|[^<]++|<"""
_NAME = r"^</?([A-Za-z][A-Za-z0-9:-]*)"
_CLASS = r"""(?i)\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def unescape(c: Column) -> Column:
    """Character references as characters: numbers and the names of HTML 4; others stay."""
    names = F.create_map(*(F.lit(x) for n, k in [*name2codepoint.items(), ("apos", 39)] for x in (n, chr(k))))

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, ENTITY, 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
        number = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.when(name.startswith("#"), number).otherwise(F.try_element_at(names, name))
        return F.when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substring(part, F.length(name) + 2, F.length(part))))

    parts = F.split(c, "&")
    return F.when(F.contains(c, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), read), ""))).otherwise(c)


def tokens(html: Column) -> Column:
    """array<struct<kind, name, class, text>>: kinds are open, close, text and skip."""
    bare = F.regexp_replace(F.regexp_replace(html, _SKIPPED, "<!>"), _STRAY, "&lt;")

    def read(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, _NAME, 1))
        kind = F.when(~t.startswith("<"), "text").when(name == "", "skip").when(t.startswith("</"), "close").when(name.isin(*VOID) | t.endswith("/>"), "skip").otherwise("open")
        quoted = F.regexp_extract(t, _CLASS, 1)
        return F.struct(kind.alias("kind"), name.alias("name"), F.trim(F.translate(quoted, "\"'", "")).alias("class"), F.when(kind == "text", t).alias("text"))

    return F.transform(F.regexp_extract_all(bare, F.lit(_TOKEN), 0), read)


def page_nodes(html: Column) -> Column:
    """array<struct<text, tag, class>>: the visible texts of a page in order, each with the element around it.

    A closing tag closes all that was opened since its element; one without an
    open element is passed over.  Texts outside of any element, in hidden ones
    and single newlines are left out.  Null gives null, an empty page no texts.
    """
    element, node = "array<struct<name:string,class:string>>", "array<struct<text:string,tag:string,class:string>>"
    none = F.array().cast(node)

    def step(s: Column, t: Column) -> Column:
        stack, top = s["stack"], F.try_element_at(s["stack"], F.lit(-1))
        back = F.array_position(F.reverse(F.transform(stack, lambda x: x["name"])), t["name"])
        closed = F.when(back > 0, F.slice(stack, F.lit(1), F.size(stack) - back.cast("int"))).otherwise(stack)
        moved = F.when(t["kind"] == "open", F.concat(stack, F.array(F.struct(t["name"].alias("name"), t["class"].alias("class"))))).when(t["kind"] == "close", closed).otherwise(stack)
        shown = (t["kind"] == "text") & top.isNotNull() & ~top["name"].isin(*HIDDEN) & (t["text"] != "\n")
        one = F.array(F.struct(unescape(t["text"]).alias("text"), top["name"].alias("tag"), top["class"].alias("class")))
        return F.struct(moved.alias("stack"), F.when(F.coalesce(shown, F.lit(False)), F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    def run(parsed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parsed), F.lit(1)), F.lit(RUN))
        begin = F.struct(F.array().cast(element).alias("stack"), none.alias("out"))

        def join(s: Column, at: Column) -> Column:
            inner = F.aggregate(F.slice(parsed, at, F.lit(RUN)), F.struct(s["stack"].alias("stack"), none.alias("out")), step)
            return F.transform(F.array(inner), lambda x: F.struct(x["stack"].alias("stack"), F.concat(s["out"], x["out"]).alias("out")))[0]

        return F.aggregate(starts, begin, join, lambda s: s["out"])

    # one-element arrays bind a value to a name, so it is worked out once
    return F.transform(F.array(tokens(html)), run)[0]


def simple_observation(nodes: Column) -> Column:
    """The texts, stripped and parted by [SEP]."""
    return F.array_join(F.transform(nodes, lambda n: X.strip(n["text"])), " [SEP] ")


def rich_observation(nodes: Column, url: Column, seen: Column) -> Column:
    """One line a text; buttons, options and product links are marked, those chosen as clicked.

    An option is chosen if ``url`` holds it in double quotes, and is named at the
    top, the last one first; a product link if ``seen`` holds it.
    """
    chosen = lambda n: (n["tag"] == "label") & F.contains(url, F.concat(F.lit('"'), n["text"], F.lit('"')))

    def line(n: Column) -> Column:
        link = n["class"] == "product-link"
        wrap = lambda before, word: F.concat(F.lit(f"{before}[{word}] "), n["text"], F.lit(f" [{word}_]"))
        return (
            F.when(n["tag"] == "button", wrap("", "button"))
            .when(chosen(n), wrap("  ", "clicked button"))
            .when(n["tag"] == "label", wrap("  ", "button"))
            .when(link & F.array_contains(seen, n["text"]), wrap("\n", "clicked button"))
            .when(link, wrap("\n", "button"))
            .otherwise(n["text"])
        )

    heads = F.reverse(F.transform(F.filter(nodes, chosen), lambda n: F.concat(F.lit("You have clicked "), n["text"], F.lit(".\n"))))
    return F.concat(F.array_join(heads, ""), F.array_join(F.transform(nodes, lambda n: F.concat(line(n), F.lit("\n"))), ""))
