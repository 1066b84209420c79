"""Lexers of Python, JavaScript, JSON and TOML, and the pairs of tokens that their grammars permit side by side.

A lexer turns a source text into kinds of tokens; names, numbers and strings lose their text. Where the grammar
gives a bracket or name several roles, the kind says which: ``(f`` opens parameters, ``{k`` a class body, ``{o`` an
object. Characters that start no token give the kind ERR. The first token is BOF, the last EOF.
"""

from __future__ import annotations

import re
import zlib
from datetime import datetime
from itertools import product

LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "json": "json", "toml": "toml"}
Token = tuple[str, int]

# ---------------------------------------------------------------- Python

PY_KEYWORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global "
    "if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
PY = re.compile(
    r"""(?P<skip>[ \t\f]+|\#[^\n\r]*|\\\r?\n)|(?P<line>\r\n?|\n)
    |(?P<str>(?:[rbuft]|[rR][bBfFtT]|[bBfFtT][rR]|[RBUFT])?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''
        |(?!\"\"\"|''')(?:"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')))
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
        |(?:(?:[1-9](?:_?[0-9])*|0(?:_?0)*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?
        |[0-9](?:_?[0-9])*[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|(?:[1-9](?:_?[0-9])*|0(?:_?0)*)[jJ]?)(?!\w))
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^]=|[-+*/%@&|^=<>()\[\]{},:.;~])""",
    re.X,
)


# Words that begin a statement only if a name, a value or a bracket follows them, apart.
PY_SOFT = {"match", "case", "type"}
PY_OBJECT = re.compile(r"[ \t]+(?!(?:and|or|in|is|if|else|not in)\b)(?:[\w\"'\[{*]|[-~(](?=.*:))")


def lex_python(source: str) -> list[Token]:
    """Second of a token: the indent if it is the first of a logical line, else -1. NL ends a logical line."""
    out, depth, fresh, column, at, end = [("BOF", -1)], 0, True, 0, 0, len(source)
    while at < end:
        m = PY.match(source, at)
        if not m:
            out.append(("ERR", -1))
            break
        group, text, at = m.lastgroup, m.group(), m.end()
        if group == "skip":
            if fresh and text[0] in " \t\f":
                column = len(text.expandtabs(8))
            continue
        if group == "line":
            if not depth and not fresh:
                out.append(("NL", -1))
            if not depth:
                fresh, column = True, 0
            continue
        if group == "str":
            quoted = text.lstrip("rRbBuUfFtT")
            inside = quoted.replace("{{", "").replace("}}", "")
            prefix = text[: len(text) - len(quoted)].lower()
            plain = not re.search(r"[\"'\\]", inside.strip("\"'"))
            kind = "ERR" if ("f" in prefix and plain and quoted.count("{") != quoted.count("}") and inside.count("{") != inside.count("}")) or ("b" in prefix and not text.isascii()) else "str"
        elif group == "num":
            kind = "num"
        elif group == "name":
            kind = text if text in PY_KEYWORDS else "id"
            if fresh and text in PY_SOFT and PY_OBJECT.match(source, at):
                kind = "soft"
        else:
            kind = text
            if text in "([{":
                depth += 1
            elif text in ")]}":
                depth = max(0, depth - 1)
        out.append((kind, column if fresh else -1))
        fresh = False
    if not fresh:
        out.append(("NL", -1))
    return [*out, ("EOF", -1)]


def python_pairs() -> set[tuple[str, str, str]]:
    value = {"id", "num", "str", "None", "True", "False", "..."}
    closers = {")": "(", "]": "[", "}": "{"}
    ends = value | set(closers)
    unary = {"-", "+", "~", "not", "await", "lambda"}
    starts = value | set("([{") | unary
    binary = {"+", "-", "*", "/", "//", "%", "@", "**", "<<", ">>", "&", "|", "^", "<", ">", "<=", ">=", "==", "!=", "and", "or", "in", "is", "not"}
    assigns = {"=", "+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}
    heads = {"if", "while", "for", "with", "def", "class", "try", "async", "return", "raise", "assert", "del", "pass", "break", "continue", "global", "nonlocal", "import", "from", "yield", "@"}
    clauses = {"elif", "else", "except", "finally"}
    simple = starts | heads | {"*"}
    flat, inside = [""], ["(", "[", "{"]
    pairs: set = set()

    def allow(contexts, left, right):
        pairs.update(product(contexts, left, right))

    every = flat + inside
    allow(every, ends, binary | {".", "(", "[", ",", ":", ":=", "if", "else", "for", "async", "as", "from"})
    allow(every, {"str"}, {"str"})
    allow(["("], ends, {"="})
    allow(flat, ends, assigns | {";", "NL"})
    allow(flat, {"id", ")"}, {"import", "->"})
    for closer, opener in closers.items():
        allow([opener], ends | {",", opener, ":", "*", "/"}, {closer})
    allow(every, binary | {":=", "=", "if", "else", "in", "await", "not", "-", "+", "~", "and", "or"}, starts | {"yield"})
    allow(every, {"is"}, starts)
    allow(every, {"not"}, {"in"})
    allow(flat, assigns, starts | {"*", "yield"})
    allow(["("], {"/"}, {","})
    allow(flat, {"soft"}, starts | {"*"})
    allow(flat, {"BOF", "NL", ";", ":"}, {"soft"})
    allow(flat, {"id"}, {"["})
    allow(inside, {"(", "[", "{", ","}, starts | {"*", "**", "yield", "/"})
    allow(inside, {"*"}, {","})
    allow(flat, {","}, starts | {"*", "**", "NL", "="})
    allow(every, {"*", "**"}, starts)
    allow(every, {"lambda"}, {"id", ":", "*", "**"})
    allow(every, {":"}, starts | {"*"})
    allow(["["], {"[", ",", ":"}, {":"})
    allow(["["], {":"}, {","})
    allow(every, {"."}, {"id"})
    allow(flat, {".", "..."}, {"import", ".", "...", "id"})
    allow(flat, {"from"}, {".", "...", "id"})
    allow(every, {"from"}, starts)
    allow(every, {"for"}, {"id", "(", "[", "*"})
    allow(every, {"async"}, {"for", "def", "with"})
    allow(every, {"as"}, {"id", "(", "["})
    allow(flat, {"import"}, {"id", "(", "*"})
    allow(flat, {"*"}, {"NL"})
    allow(flat, {"BOF", "NL", ";"}, simple | {"EOF"})
    allow(flat, {";"}, {"NL"})
    allow(flat, {"NL"}, clauses)
    allow(flat, {":"}, simple | {"NL"})
    allow(flat, {"if", "while", "elif", "with", "return", "raise", "assert", "del", "except"}, starts)
    allow(flat, {"return", "raise", "yield", "pass", "break", "continue"}, {"NL", ";"})
    allow(every, {"yield"}, starts | {"from", ")"})
    allow(flat, {"return"}, {"*"})
    allow(flat, {"def", "class", "global", "nonlocal"}, {"id"})
    allow(flat, {"try", "else", "finally", "except"}, {":"})
    allow(flat, {"except"}, {"*"})
    allow(flat, {"->", "@"}, starts)
    return pairs


# One alternative for each form of a statement, over the kinds of its tokens with the insides of brackets left out. What is
# assigned to or deleted is a name, a bracket of such, or a chain that ends in an attribute or a subscript.
PY_CHAIN = r"(?:id|str|\(|\[|\{)(?: \. id| \(| \[)*(?: \. id| \[)"
PY_TARGET = rf"(?:\* )?(?:{PY_CHAIN}|id|\(|\[)"
PY_TARGETS = rf"{PY_TARGET}(?: , {PY_TARGET})*(?: ,)?"
PY_EXPRESSION = r"(?!(?:async|def|class|if|elif|while|with|for|try|else|finally|except|import|from|return|raise|assert|del|global|nonlocal|pass|break|continue|@)(?: |$))(?:(?! (?:;|=|%s) |:).)+" % "|".join(re.escape(x) for x in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
PY_LAMBDA = r"(?:.* )?lambda(?: .*)?"
PY_STATEMENT = "^(?:" + "|".join(
    [
        r"(?:async )?def id(?: \[)? \((?: -> \S.*?)? :(?: .+)?",
        r"class id(?: \[)?(?: \()? :(?: .+)?",
        r"(?:if|elif|while) (?:(?! = )(?!lambda).)+ :(?: .+)?",
        r"(?:if|elif|while|return|raise|assert|yield|await|@) .*lambda .*",
        r"(?:async )?with (?:(?! = ).)+ :(?: .+)?",
        rf"(?:async )?for {PY_TARGETS} in \S.* :(?: .+)?",
        r"(?:try|else|finally) :(?: .+)?",
        r"except(?: (?:\* )?(?:(?! , ).)+?(?: as id)?)? :(?: .+)?",
        r"import id(?: \. id)*(?: as id)?(?: , id(?: \. id)*(?: as id)?)*",
        r"from (?:\. |\.\.\. )*(?:id (?:\. id )*)?import (?:\(|\*|id(?: as id)?(?: , id(?: as id)?)*)",
        rf"del {PY_TARGETS}",
        r"raise(?: (?:(?! [,=] ).)*[^:])?",
        r"(?:global|nonlocal) id(?: , id)*",
        r"(?:return|assert|yield|@|await|not)(?: (?:(?! = ).)*[^:])?",
        r"(?:pass|break|continue)",
        rf"(?:{PY_TARGETS} = )+(?:yield(?: .+)?|{PY_EXPRESSION}|{PY_LAMBDA})",
        rf"(?:{PY_CHAIN}|id) (?:{'|'.join(re.escape(x) for x in '+= -= *= /= //= %= @= &= |= ^= >>= <<= **='.split())}) (?:yield(?: .+)?|{PY_EXPRESSION}|{PY_LAMBDA})",
        rf"(?:{PY_CHAIN}|id|\() : {PY_EXPRESSION}(?: = (?:yield(?: .+)?|{PY_EXPRESSION}|{PY_LAMBDA}))?",
        rf"{PY_EXPRESSION}",
        rf"{PY_LAMBDA}",
        # soft keywords
        r"soft .+ :(?: .+)?",
        r"soft id(?: \[)? = .+",
    ]
) + ")$"

# ---------------------------------------------------------------- JSON

JSON = re.compile(
    r"""(?P<skip>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")
    |(?P<val>(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-]))|(?P<op>[\[\]{},:])""",
    re.X,
)


def lex_json(source: str) -> list[Token]:
    """A string in the place of a member's name is of the kind key."""
    out, opened, at = [("BOF", -1)], [], 0
    while at < len(source):
        m = JSON.match(source, at)
        if not m:
            out.append(("ERR", -1))
            break
        group, at = m.lastgroup, m.end()
        if group == "skip":
            continue
        kind = m.group() if group == "op" else group
        if kind == "str" and opened and opened[-1] == "{" and out[-1][0] in "{,":
            kind = "key"
        if kind in "[{":
            opened.append(kind)
        elif kind in "]}" and opened:
            opened.pop()
        out.append((kind, -1))
    return [*out, ("EOF", -1)]


def json_pairs() -> set[tuple[str, str, str]]:
    ends, starts = {"str", "val", "]", "}"}, {"str", "val", "[", "{"}
    pairs: set = set(product([""], {"BOF"}, starts)) | set(product([""], ends, {"EOF"}))
    pairs |= set(product(["["], {"[", ","}, starts)) | set(product(["["], ends, {",", "]"})) | {("[", "[", "]"), ("{", "{", "}")}
    pairs |= set(product(["{"], {"{", ","}, {"key"})) | {("{", "key", ":")} | set(product(["{"], {":"}, starts)) | set(product(["{"], ends, {",", "}"}))
    return pairs


# ---------------------------------------------------------------- TOML

TOML = re.compile(
    r"""(?P<skip>[ \t]+|\#[^\n\r]*)|(?P<line>\r?\n)
    |(?P<text>\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"(?:\"(?!\")|\"\"(?!\"))?|'''[\s\S]*?'''(?:'(?!')|''(?!'))?)
    |(?P<str>(?!\"\"\"|''')(?:"(?:[^"\\\n\r]|\\(?:["\\bfnrt]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|'[^'\n\r]*'))
    |(?P<val>(?:true|false|[+-]?(?:inf|nan)|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?
        |0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*
        |[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w.:+-]))
    |(?P<key>[A-Za-z0-9_-]+)|(?P<op>[\[\]{},.=])""",
    re.X,
)


def lex_toml(source: str) -> list[Token]:
    """Second of a token: the hash of a key's name, else -1. ``h[`` and ``h]`` are brackets of a table's header; line ends
    inside of brackets are left out."""
    out, opened, at, value = [("BOF", -1)], [], 0, False
    while at < len(source):
        m = TOML.match(source, at)
        if not m:
            out.append(("ERR", -1))
            break
        group, at = m.lastgroup, m.end()
        kind, value_of = m.group() if group == "op" else group, -1
        if group == "skip" or (group == "line" and "[" in opened):
            continue
        if group == "val" and value and re.match(r"\d{4}-|\d\d:", m.group()) and not real_time(m.group()):
            kind = "ERR"
        last = out[-1][0]
        if group == "line":
            kind, value = "NL", False
        elif kind == "=":
            value = True
        elif kind == "[" and not value and last in ("NL", "BOF", "h["):
            kind = "h["
        elif kind == "]" and opened and opened[-1] == "h[":
            kind = "h]"
        elif kind in ("str", "val") and (not value or (opened and opened[-1] == "{" and last in "{,.")) and (kind == "str" or re.fullmatch("[A-Za-z0-9_-]+", m.group())):
            kind = "key"
        if kind == "key":
            name = m.group()
            name = name[1:-1] if name[0] in "\"'" and "\\" not in name else name
            value_of = zlib.crc32(name.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
        if kind in ("[", "{", "h["):
            opened.append(kind)
        elif kind in ("]", "}", "h]") and opened:
            opened.pop()
        out.append((kind, value_of))
    return [*out, ("NL", -1), ("EOF", -1)]


def real_time(text: str) -> bool:
    """Whether a date, a time or both, of the right form, are real ones; the second 60 is."""
    try:
        datetime.fromisoformat(re.sub(r":60(?=\D|$)", ":59", text if "-" in text[:5] else f"2000-01-01T{text}").replace("t", "T").replace("z", "Z"))
    except ValueError:
        return False
    return True


def toml_pairs() -> set[tuple[str, str, str]]:
    ends, starts = {"text", "str", "val", "]", "}"}, {"text", "str", "val", "[", "{"}
    pairs: set = set(product([""], {"BOF", "NL"}, {"NL", "EOF", "key", "h["})) | set(product([""], ends | {"h]"}, {"NL"}))
    pairs |= set(product(["", "h[", "{"], {"key"}, {"."})) | set(product(["", "h[", "{"], {"."}, {"key"})) | set(product(["", "{"], {"key"}, {"="})) | set(product(["", "{"], {"="}, starts))
    pairs |= set(product(["h["], {"h["}, {"key", "h["})) | set(product(["h["], {"key", "h]"}, {"h]"}))
    pairs |= set(product(["["], {"[", ","}, starts | {"]"})) | set(product(["["], ends, {",", "]"}))
    pairs |= set(product(["{"], {"{", ","}, {"key"})) | set(product(["{"], ends, {",", "}"})) | {("{", "{", "}")}
    return pairs


# ---------------------------------------------------------------- JavaScript

JS_KEYWORDS = set(
    "await break case catch class const continue debugger default delete do else export extends false finally for function if import in "
    "instanceof let new null return super switch this throw true try typeof var void while with yield".split()
)
JS = re.compile(
    r"""(?P<line>[\n\r\u2028\u2029])|(?P<skip>[ \t\f\v\u00a0\ufeff]+|//[^\n\r\u2028\u2029]*)|(?P<block>/\*[\s\S]*?\*/)
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+n?|0[bB](?:_?[01])+n?|0[oO](?:_?[0-7])+n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?|(?:0|[1-9](?:_?\d)*)n)(?![\w$]))
    |(?P<name>\#?[^\W\d][\w$]*|\#?\$[\w$]*)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|\*\*|<<|>>|[-+*/%&|^!~<>=?:;,.()\[\]{}@])""",
    re.X,
)
JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")
JS_NEXT, JS_BEHIND = re.compile(r"[ \t]*(.?)"), re.compile(r"\s*(\S?)")
JS_ASYNC, JS_PARAMETERS, JS_ARROW = re.compile(r"[ \t]*(?:function\b|[\w$]+[ \t]*=>)"), re.compile(r"[ \t]*\("), re.compile(r"[ \t]*=>")
JS_ENDS = {"id", "oprop", "num", "str", "tpl", "re", ")", "]", "}o", "}e", "}k", "true", "false", "null", "this", "super", "++", "--", "cid", "did", "prop"}
JS_BINARY = set("+ - * / % ** == != === !== < > <= >= << >> >>> & | ^ && || ?? instanceof in".split())
JS_ASSIGN = set("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


def template_end(source: str, at: int) -> int:
    """Where the template that begins at ``at`` ends, with templates and braces nested in it; -1 if it doesn't."""
    stack, at = ["`"], at + 1
    while at < len(source):
        c = source[at]
        if stack[-1] == "`":
            if c == "\\":
                at += 1
            elif c == "`":
                stack.pop()
                if not stack:
                    return at + 1
            elif source.startswith("${", at):
                stack.append("{")
                at += 1
        elif c in "`{":
            stack.append(c)
        elif c == "}":
            stack.pop()
        elif c in "\"'":
            m = JS.match(source, at)
            if not m:
                return -1
            at = m.end() - 1
        at += 1
    return -1


def bracket_end(source: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes, with brackets, strings and templates nested in it; -1 if it doesn't."""
    depth = 0
    while at < len(source):
        if source[at] == "`":
            at = template_end(source, at)
            if at < 0:
                return -1
            continue
        m = JS.match(source, at)
        if not m:
            return -1
        at = m.end()
        if m.lastgroup == "op" and m.group() in "([{":
            depth += 1
        elif m.lastgroup == "op" and m.group() in ")]}":
            depth -= 1
            if not depth:
                return at
    return -1


def lex_javascript(source: str) -> list[Token]:
    """Second of a token: 1 after a line break, else 0.

    Names: cid and did are declared by const and by let or var, fid a function's, kid a class's, iid imported as
    default, mid of a class member, prop behind a dot. Brackets: ``(c`` of if, while, for, switch, with and catch,
    ``(f`` of parameters; ``{b`` block, ``{t`` of try, ``{f`` body of a declared function or method, ``{e`` of a
    function in an expression, ``{k`` class body, ``{o`` object, ``{i`` import list, ``{x`` export list. ``:t`` is
    the colon of a conditional, ``:c`` that of a case.
    """
    out: list[Token] = [("BOF", 0)]
    opened: list[str] = []
    ternary, cases = [0], [False]
    at, broken, function, klass = 0, 0, "", -1
    if source.startswith("#!"):
        at = len(source.split("\n", 1)[0])
    while at < len(source):
        last = out[-1][0]
        before = out[-2][0] if len(out) > 1 else ""
        around = opened[-1] if opened else ""
        if source[at] == "`":
            at = template_end(source, at)
            out.append(("tpl" if at > 0 else "ERR", broken))
            if at < 0:
                break
            broken = 0
            continue
        if source[at] == "/" and last not in JS_ENDS and last not in ("mid", ")f"):
            m = JS_REGEX.match(source, at)
            if m:
                out.append(("re", broken))
                at, broken = m.end(), 0
                continue
        m = JS.match(source, at)
        if not m:
            out.append(("ERR", broken))
            break
        group, text, at = m.lastgroup, m.group(), m.end()
        if group == "line" or group == "skip" or group == "block":
            broken |= group == "line" or (group == "block" and "\n" in text)
            continue
        kind = group
        if group == "name":
            if last in (".", "?."):
                kind = "prop" if last == "." else "oprop"
            elif around == "{k" and last in ("{k", "}f", ";", "mod", "*", "mid") or (around == "{k" and broken):
                after = JS_NEXT.match(source, at).group(1)
                kind = "mod" if text in ("static", "async", "get", "set") and after not in ("(", "=", ";", "}", "\n", "\r", "") else "mid"
            elif text.startswith("#"):
                kind = "id"
            elif text in JS_KEYWORDS:
                kind = text
                if around == "{o" and last in ("{o", ",") and JS_BEHIND.match(source, at).group(1) in (":", "(", ","):
                    kind = "id"
                elif text == "class":
                    klass = len(opened)
                elif text == "case" or (text == "default" and last != "export"):
                    cases[-1] = True
                elif text == "function":
                    function = "{f" if last in ("BOF", ";", "{b", "{f", "{e", "{t", "}b", "}f", "}k", "}t", "export", "default", "async") or broken else "{e"
            elif last == "import":
                kind = "iid"
            elif text == "from" and last in ("iid", "}i", "}x", "sid"):
                kind = "from"
            elif text == "as" and (last == "*" or around in ("{i", "{x")):
                kind = "as"
            elif last == "as" and before == "*":
                kind = "sid"
            elif last == "const":
                kind = "cid"
            elif last in ("let", "var"):
                kind = "did"
            elif last == "function" or (last == "*" and before == "function"):
                kind = "fid"
            elif last == "class" and text != "extends":
                kind = "kid"
            elif text == "of" and last in ("cid", "did", "]", "}o"):
                kind = "of"
            elif text == "async" and JS_ASYNC.match(source, at):
                kind = "async"
            elif text == "async" and (m := JS_PARAMETERS.match(source, at)):
                end = bracket_end(source, m.end() - 1)
                kind = "async" if end < 0 or JS_ARROW.match(source, end) else "id"
            else:
                kind = "id"
        elif group == "op":
            kind = text
            if text == "(":
                if last in ("if", "while", "for", "switch", "with", "catch") or (last == "await" and before == "for"):
                    kind = "(c"
                elif last in ("fid", "function", "mid") or (last == "*" and before == "function") or (around == "{k" and last in ("]", "str", "num")):
                    kind = "(f"
                elif around == "{o" and last in ("id", "str", "num", "]") and before in ("{o", ",", "id", "*", "async"):
                    kind = "(f"
            elif text == "{":
                if klass == len(opened) and last != "extends":
                    kind, klass = "{k", -1
                elif last == "mod" and around == "{k":
                    kind = "{f"
                elif last == ":" and around in ("", "{b", "{f", "{e", "{t"):
                    kind = "{b"
                elif last == "try":
                    kind = "{t"
                elif last == ")f":
                    kind, function = (function or ("{f" if around == "{k" else "{e")), ""
                elif last == "=>":
                    kind = "{e"
                elif last == "import" or (last == "," and before == "iid"):
                    kind = "{i"
                elif last == "export":
                    kind = "{x"
                elif last in (")c", "else", "do", "finally", "catch", "BOF", ";", "{b", "{f", "{e", "{t", "}b", "}f", "}k", "}t") or last == ":c":
                    kind = "{b"
                elif last in JS_ENDS and around in ("", "{b", "{f", "{e", "{t") and broken:
                    kind = "{b"
                else:
                    kind = "{o"
            elif text in ")}]":
                kind = text + around[1:] if around[:1] == {")": "(", "}": "{", "]": "["}[text] else text
            elif text == "?":
                ternary[-1] += 1
            elif text == ":" and ternary[-1]:
                ternary[-1] -= 1
                kind = ":t"
            elif text == ":" and cases[-1]:
                cases[-1], kind = False, ":c"
            if kind[0] in "([{":
                opened.append(kind)
                ternary.append(0)
                cases.append(False)
            elif kind[0] in ")]}" and opened:
                opened.pop()
                ternary.pop()
                cases.pop()
        out.append((kind, int(broken)))
        broken = 0
    return [*out, ("EOF", 1)]


def javascript_pairs() -> set[tuple[str, str, str]]:
    """Contexts end with a line break mark: ``{b`` and ``{b+`` are the same context without and with one."""
    blocks = ["", "{b", "{f", "{e", "{t"]
    inner = ["(", "(c", "(f", "[", "{o"]
    every = [*blocks, *inner, "{k"]
    closing = {"(": ")", "(c": ")c", "(f": ")f", "[": "]", "{o": "}o", "{b": "}b", "{f": "}f", "{e": "}e", "{t": "}t", "{k": "}k", "{i": "}i", "{x": "}x"}
    ends = JS_ENDS
    prefix = {"!", "~", "+", "-", "typeof", "void", "delete", "await", "yield", "++", "--", "new"}
    starts = {"id", "num", "str", "tpl", "re", "(", "[", "{o", "function", "class", "async", "this", "super", "null", "true", "false", "import"} | prefix
    statements = starts | {"{b", "if", "for", "while", "do", "switch", "try", "throw", "return", "break", "continue", "const", "let", "var", "export", ";", "debugger", "with"}
    over = {"}b", "}f", "}k", ";"}
    pairs: set = set()

    def allow(contexts, left, right, breaks=(0, 1)):
        for c in contexts:
            for b in breaks:
                pairs.update(product([c + "+" * b], left, right))

    allow([""], {"BOF"}, statements | {"EOF"})
    for b in blocks:
        if b:
            allow([b], {b}, statements)
    for b in ["{b", "{f", "{e", "{t"]:
        allow([b], {b} | over | ends | {"return", "break", "continue", "debugger", "yield", "did"}, {closing[b]})
    allow([""], over | ends | {"return", "break", "continue", "debugger", "}i", "}x", "did"}, {"EOF"})
    allow(blocks, {"}b", "}f", ";", "}k"}, statements | {"else", "while", "case", "default"})
    allow(blocks, {"}b"}, {"finally"})
    allow(blocks, {"}t"}, {"catch", "finally"})
    allow(blocks, ends - {"++", "--"} | {"++", "--"}, statements | {"case", "default", "else", "while"}, breaks=(1,))
    allow(blocks, ends | {"return", "break", "continue", "debugger", "}i", "}x", "did", "}k", "}e", "}f"}, {";"})
    allow(blocks, {"return", "break", "continue", "debugger", "}i", "}x", "did"}, statements | {"case", "default"}, breaks=(1,))
    allow(every, ends | {"}f"}, JS_BINARY | {".", "?.", "(", "[", "tpl", "?", ",", ":t"})
    allow(every, {"id", "prop", "]", ")", "}o", "did", "cid"}, JS_ASSIGN)
    allow(every, ends, {"++", "--"}, breaks=(0,))
    allow(every, {"id", ")", "}o"}, {"=>"}, breaks=(0,))
    allow(["(f"], {"id", "]", "}o"}, {"=", ","})
    allow(every, JS_BINARY | JS_ASSIGN | prefix - {"++", "--"} | {"?", ":t", "=>", "(", "[", "(c", "..."}, starts)
    allow(every, {"=>"}, {"{e"})
    allow(every, {"++", "--"}, {"id", "this", "(", "super"})
    allow(every, {"."}, {"prop"})
    allow(every, {"?."}, {"oprop", "(", "["})
    allow(["new"], {"new"}, {"."})
    allow([*blocks, "(", "(c", "(f", "[", "{o"], {","}, starts | {"..."})
    allow(inner, {"(", "[", "(f"}, {"..."})
    allow(["["], {"[", ","}, {",", "]"})
    for c in ("(", "(c", "(f", "["):
        allow([c], ends | {c if c != "(c" else ";", ","}, {closing[c]})
    allow(["(f"], {"(f"}, {"id", "[", "{o", "..."})
    allow(["(c"], {"(c", ";"}, {"const", "let", "var", ";"})
    allow(["(c"], ends | {"(c", ";", "did"}, {";"})
    allow(["(c"], {";"}, starts | {")c"})
    allow(["(c"], {"cid", "did", "]", "}o", "id", "prop"}, {"of", "in"})
    allow(every, {"of"}, starts)
    # objects
    allow(["{o"], {"{o", ","}, {"id", "str", "num", "[", "...", "*", "async", "}o", "(f"})
    allow(["{o"], {"id", "str", "num", "]"}, {":", "(f"})
    allow(["{o"], {"async", "*"}, {"id", "str", "["})
    allow(["{o"], {"id"}, {"id", "="}, breaks=(0,))
    allow(["{o"], {":"}, starts)
    allow(["{o"], ends | {"}f", "}e"}, {",", "}o"})
    # declarations and names
    allow(blocks, {"const", "let", "var"}, {"[", "{o"})
    allow([*blocks, "(c"], {"const"}, {"cid", "[", "{o"})
    allow([*blocks, "(c"], {"let", "var"}, {"did", "[", "{o"})
    allow([*blocks, "(c"], {"did"}, {"=", ",", "of", "in"})
    allow(every, {"function"}, {"fid", "(f", "*"})
    allow(every, {"*"}, {"fid", "(f"})
    allow(every, {"fid", "mid"}, {"(f"})
    allow(every, {")f"}, {"{f", "{e"})
    allow(every, {"class"}, {"kid", "{k", "extends"})
    allow(every, {"kid"}, {"{k", "extends"})
    allow(every, {"extends"}, starts)
    allow(every, ends, {"{k"})
    allow(every, {"async"}, {"function", "("}, breaks=(0,))
    allow(every, {"async"}, {"id"}, breaks=(0,))
    # class bodies
    allow(["{k"], {"{k", "}f", ";"}, {"mid", "mod", "}k", ";", "*", "[", "str", "{b"})
    allow(["{k"], {"mod", "*"}, {"mid", "*", "[", "str", "{b", "mod"})
    allow(["{k"], {"mid", "]", "str", "num"}, {"(f", "=", ";"})
    allow(["{k"], {"{k", "}f", ";", "mod", "*"}, {"num"})
    allow(["{k"], {"mod"}, {"{f"})
    allow(["{f"], {"{f"}, statements)
    allow(["{k"], ends | {"mid"}, {";", "}k"})
    allow(["{k"], ends | {"mid"}, {"mid", "mod", "[", "*"}, breaks=(1,))
    # statements
    allow(blocks, {"if", "while", "for", "switch", "with", "catch"}, {"(c"})
    allow(blocks, {"for"}, {"await"})
    allow(blocks, {"await"}, {"(c"})
    allow(blocks, {"catch", "finally", "do"}, {"{b"})
    allow(blocks, {"do", "else"}, statements)
    allow(blocks, {")c"}, statements)
    allow(blocks, {"try"}, {"{t"})
    allow(blocks, {"throw"}, starts, breaks=(0,))
    allow(blocks, {"return", "yield"}, starts, breaks=(0,))
    allow(blocks, {"break", "continue"}, {"id"}, breaks=(0,))
    allow(blocks, {"case"}, starts)
    allow(["{b"], {"{b"}, {"case", "default"})
    allow(["{b"], {"default", *ends}, {":c"})
    allow(["{b"], {":c"}, statements | {"case", "default", "}b"})
    allow(blocks, {"id"}, {":"})
    allow(blocks, {":"}, statements)
    # modules
    allow([""], {"import"}, {"iid", "{i", "*", "str"})
    allow(every, {"import"}, {"(", "."})
    allow([""], {"iid"}, {"from", ","})
    allow([""], {","}, {"{i", "*"})
    allow([""], {"*"}, {"as", "from"})
    allow(["", "{i", "{x"], {"as"}, {"id", "sid", "default", "str"})
    allow([""], {"sid", "}i", "}x"}, {"from"})
    allow([""], {"from"}, {"str"})
    allow([""], {"str"}, {"with"})
    allow([""], {"with"}, {"{o"})
    for c in ("{i", "{x"):
        allow([c], {c, ","}, {"id", "default", "str", closing[c]})
        allow([c], {"id", "default", "str"}, {"as", ",", closing[c]})
    allow([""], {"export"}, {"default", "const", "let", "var", "function", "class", "async", "{x", "*"})
    allow([""], {"default"}, starts)
    # A constant must get a value.
    return {p for p in pairs if p[1] != "cid" or p[2] in ("=", "of", "in")}


LEXERS = {"python": lex_python, "javascript": lex_javascript, "json": lex_json, "toml": lex_toml}


def permitted_pairs() -> list[tuple[str, str, str, str]]:
    """(language, context, left, right) for all languages; the context is the kind of the innermost open bracket."""
    rules = {"python": python_pairs(), "json": json_pairs(), "toml": toml_pairs(), "javascript": javascript_pairs()}
    return sorted((language, *pair) for language, pairs in rules.items() for pair in pairs)
