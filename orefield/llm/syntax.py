"""Source files that do not parse.

Method: a lexer per language with a pushdown stack. The lexer finds unterminated literals and
comments and merge-conflict markers; the stack finds unbalanced delimiters and premature ends (and, for
indented languages, broken blocks); rules on neighbouring tokens find texts that are not of the
language at all, and statements cut inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# File extensions of the languages judged here, and other names of the languages.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "py": "python", "php": "php", "go": "go", "rs": "rust",
}
ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "golang": "go", "rs": "rust", "python3": "python"}

OPEN, CLOSE = "([{", {")": "(", "]": "[", "}": "{"}
CONFLICT = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?: [^\n]*)?(?=\n|$)")
NUMBER = r"(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.(?!\.)\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"


class SyntaxFault(Exception):
    """Why a text is no valid source."""


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


class Language:
    """Lexical table of a language. Tokens are (kind, text, line start) with kinds word, var, num, str, op, open, close."""

    comment = r"//[^\n]*|/\*(?s:.*?)\*/"
    strings = r'"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\(?s:.))*\''
    word = r"[^\W\d]\w*"
    operators = r">>>=|===|!==|\*\*=|<<=|>>=|\?\?=|&&=|\|\|=|\.\.\.|=>|->|<-|:=|::|\+\+|--|\?\?|\?\.|\*\*|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!&|^~?:;,.@]"
    suffix = r"\w*"
    keywords: frozenset[str] = frozenset()
    #: Words that are values by themselves.
    values = words("true false null")
    #: Operators that may begin an operand, and those that may end one.
    prefix = words("+ - ! ~ ++ -- ...")
    postfix = words("++ --")
    newline_ends = True

    def __init__(self) -> None:
        self.scan = re.compile(
            rf"(?P<blank>[ \t\f\v\ufeff\u00a0\u200b]+|\\\n)|(?P<line>\n)|(?P<comment>{self.comment})|(?P<str>{self.strings})"
            rf"|(?P<num>{NUMBER}{self.suffix})|(?P<word>{self.word})|(?P<op>{self.operators})|(?P<open>[(\[{{])|(?P<close>[)\]}}])"
        )

    def special(self, text: str, at: int, tokens: list) -> int | None:
        """Where a token that no regular expression describes ends; None if there is none."""
        return None

    def tokens(self, text: str) -> list[tuple[str, str, bool]]:
        out, at, fresh, size = [], 0, True, len(text)
        scan, special = self.scan.match, self.special
        while at < size:
            if (fresh or at == 0) and text[at] in "<=>|" and (at == 0 or text[at - 1] == "\n") and CONFLICT.match(text, at):
                raise SyntaxFault("merge conflict marker")
            kind_end = special(text, at, out)
            if kind_end is not None:
                kind, end = kind_end
                if kind:
                    out.append((kind, text[at:end], fresh))
                    fresh = False
                at = end
                continue
            m = scan(text, at)
            if m is None:
                raise SyntaxFault(f"unterminated literal or stray {text[at]!r}")
            kind = m.lastgroup
            if kind == "line":
                fresh = True
            elif kind == "comment":
                if "\n" in m[0]:
                    fresh = True
            elif kind != "blank":
                out.append((kind, m[0], fresh))
                fresh = False
            at = m.end()
        return out

    def fragment(self, text: str) -> list[tuple[str, str, bool]]:
        """Tokens of a piece of code that needn't be a whole file."""
        return self.tokens(text)

    def check(self, text: str) -> None:
        tokens = self.tokens(text)
        self.structure(tokens, balanced(tokens))

    def structure(self, tokens: list, partner: list[int]) -> None:
        self.neighbours(tokens, partner)

    # Rules on neighbouring tokens

    def ends_operand(self, token) -> bool:
        kind, text, _ = token
        if kind == "word":
            return text not in self.keywords or text in self.values
        return kind in ("var", "num", "str") or text in (")", "]")

    def allowed_pair(self, tokens, partner, i) -> bool:
        """Whether two neighbouring operands may stand side by side."""
        return False

    def neighbours(self, tokens: list, partner: list[int]) -> None:
        last = len(tokens) - 1
        for i, (kind, text, fresh) in enumerate(tokens):
            before = tokens[i - 1] if i else None
            if kind in ("word", "var", "num", "str") and before and self.ends_operand(before):
                if (kind != "word" or text not in self.keywords or text in self.values) and not (self.newline_ends and fresh):
                    if not self.allowed_pair(tokens, partner, i):
                        raise SyntaxFault(f"{before[1]!r} beside {text!r}")
            if kind == "op" and text in self.binary:
                if text not in self.prefix and (before is None or before[1] in ("(", "[", ";", ",") or (before[0] == "op" and before[1] in self.binary)):
                    if not self.allowed_operator(tokens, i):
                        raise SyntaxFault(f"{text!r} without a left side")
                after = tokens[i + 1] if i < last else None
                if text not in self.postfix and (after is None or after[1] in (")", "]", "}", ";", ",")) and not self.allowed_end(tokens, i):
                    raise SyntaxFault(f"{text!r} without a right side")

    binary = words("= += -= *= /= %= == === != !== && || ?? <= >= => . ?. % ^ + - / -> :=")

    def allowed_operator(self, tokens, i) -> bool:
        return False

    def allowed_end(self, tokens, i) -> bool:
        return False


def balanced(tokens: list) -> list[int]:
    """Positions of the partners of all delimiters; raises where the stack doesn't match."""
    stack, partner = [], [-1] * len(tokens)
    for i, (kind, text, _) in enumerate(tokens):
        if kind == "open":
            stack.append(i)
        elif kind == "close":
            if not stack or tokens[stack[-1]][1] != CLOSE[text]:
                raise SyntaxFault(f"unbalanced {text!r}")
            partner[i] = stack.pop()
            partner[partner[i]] = i
    if stack:
        raise SyntaxFault(f"{tokens[stack[-1]][1]!r} is never closed")
    return partner


def contexts(tokens: list, partner: list[int]) -> list[int]:
    """For each token the position of the delimiter that directly holds it, -1 at the top."""
    holder, stack = [], [-1]
    for i, (kind, _, _) in enumerate(tokens):
        if kind == "close":
            stack.pop()
        holder.append(stack[-1])
        if kind == "open":
            stack.append(i)
    return holder


class TypeScript(Language):
    keywords = words(
        "break case catch class const continue debugger default delete do else export extends finally for function if import in "
        "instanceof new return super switch this throw try typeof var void while with yield enum let await null true false"
    )
    values = words("this super null true false")
    #: Words that may stand before, or after, another operand.
    leads = words(
        "async static get set of as type from readonly declare namespace abstract is keyof infer satisfies public private "
        "protected module global override accessor unique asserts out interface implements await let"
    )
    follows = words("as of is satisfies from implements")
    typed = True
    regex = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
    word = r"#?[^\W\d](?:[\w$]|(?<=\w)\$)*|\$[\w$]*"

    def special(self, text, at, tokens):
        c = text[at]
        if c == "`":
            return "str", self.template(text, at)
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            before = tokens[-1] if tokens else None
            starts = before is None or not (self.ends_operand(before) or before[1] == "}")
            if starts:
                m = self.regex.match(text, at)
                if m is None:
                    raise SyntaxFault("unterminated regular expression")
                return "str", m.end()
        if c == "#" and at == 0 and text.startswith("#!"):
            end = text.find("\n")
            return "", len(text) if end < 0 else end
        return None

    def template(self, text: str, at: int) -> int:
        """End of a template literal; its substitutions are read with the same stack discipline."""
        at += 1
        while at < len(text):
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif text.startswith("${", at):
                at, depth, found = at + 2, 1, []
                while depth:
                    if at >= len(text):
                        raise SyntaxFault("unterminated template")
                    special = self.special(text, at, found)
                    if special is None:
                        m = self.scan.match(text, at)
                        if m is None:
                            raise SyntaxFault("unterminated template")
                        special = m.lastgroup, m.end()
                        if m.lastgroup not in ("blank", "line", "comment"):
                            found.append((m.lastgroup, m[0], False))
                        depth += (m[0] == "{") - (m[0] == "}")
                    else:
                        found.append(("str", text[at : special[1]], False))
                    at = special[1]
            else:
                at += 1
        raise SyntaxFault("unterminated template")

    def ends_operand(self, token):
        return super().ends_operand(token)

    def allowed_pair(self, tokens, partner, i):
        before, (kind, text, _) = tokens[i - 1], tokens[i]
        if before[0] == "word" and before[1] in self.leads and not (before[1] == "as" and not self.typed and not self.in_import(tokens, i)):
            return kind in ("word", "str") or before[1] in ("of", "from", "as", "await", "is")
        if kind == "word" and text in self.follows:
            return text != "as" or self.typed or self.in_import(tokens, i)
        if before[1] == ")":
            head = tokens[partner[i - 1] - 1] if partner[i - 1] > 0 else None
            return head is not None and head[1] in ("if", "for", "while", "with", "await")
        return False

    def in_import(self, tokens, i) -> bool:
        """Whether the statement of a token is an import or export."""
        while i > 0 and tokens[i][1] not in (";", "import", "export"):
            i -= 1
        return tokens[i][1] in ("import", "export")

    def allowed_end(self, tokens, i):
        return False

    def allowed_operator(self, tokens, i):
        # a method or import written with a star, and a leading | or & of a type
        return tokens[i][1] in ("*", "|", "&") and tokens[i][1] != "&"

    binary = Language.binary | words("& ||= &&= ??=")
    declares = words("const let var function class async default { * interface type enum abstract declare namespace import = module @")

    def structure(self, tokens, partner):
        self.neighbours(tokens, partner)
        holder = contexts(tokens, partner)
        last = len(tokens) - 1
        pending: dict[int, int] = {}  # open conditional operators per delimiter
        for i, (kind, text, fresh) in enumerate(tokens):
            after = tokens[i + 1] if i < last else ("end", "", True)
            before = tokens[i - 1] if i else ("end", "", True)
            member = before[1] in (".", "?.") or after[1] == ":" and holder[i] >= 0 and tokens[holder[i]][1] == "{"
            if kind == "op" and text == ";" and holder[i] >= 0 and tokens[holder[i]][1] in "([":
                head = tokens[holder[i] - 1][1] if holder[i] else ""
                if head not in ("for", "await"):
                    raise SyntaxFault("';' inside delimiters")
            if kind == "op" and text == "?":
                pending[holder[i]] = pending.get(holder[i], 0) + 1
            if kind == "op" and text == ":" and not self.typed:
                inside = tokens[holder[i]][1] if holder[i] >= 0 else ""
                if pending.get(holder[i], 0):
                    pending[holder[i]] -= 1
                elif inside == "(" or before[1] == ")" and not self.is_case(tokens, partner, i):
                    raise SyntaxFault("type annotation")
            if kind != "word" or member:
                continue
            if text == "export" and after[1] not in self.declares:
                raise SyntaxFault("incomplete export")
            if text in ("if", "while", "switch", "for", "with") and after[1] not in ("(", "await") and after[1] not in (":", ",", "="):
                raise SyntaxFault(f"incomplete {text}")
            if text == "const" and after[1] != "enum":
                self.declared(tokens, partner, i)
            if text in ("class", "interface", "namespace", "enum") and after[0] == "word" and after[1] not in self.follows and not after[2]:
                if text in ("class", "enum") or self.typed:
                    self.has_body(tokens, i)
            if text == "function":
                self.function(tokens, partner, i)
            if text == "import" and after[1] not in ("(", "."):
                self.imported(tokens, partner, i)
            if text in ("new", "typeof", "extends", "throw", "case", "delete", "void", "instanceof", "in", "let", "var", "await", "else", "try", "do", "finally", "import", "function", "class"):
                if after[1] in ("", ")", "]", "}", ";", ",") and text not in ("await",):
                    raise SyntaxFault(f"incomplete {text}")
            if text == "try" and after[1] == "{":
                close = partner[i + 1]
                if close == last or tokens[close + 1][1] not in ("catch", "finally"):
                    raise SyntaxFault("try without catch")
        if tokens and tokens[-1][0] == "word" and tokens[-1][1] in self.keywords | words("async") and tokens[-1][1] not in self.values | words("break continue return debugger"):
            raise SyntaxFault("premature end")

    def is_case(self, tokens, partner, i) -> bool:
        j = i
        while j > 0 and tokens[j][1] not in (";", "{", "}"):
            j = partner[j] - 1 if tokens[j][1] in (")", "]") and partner[j] >= 0 else j - 1
            if tokens[j][1] in ("case", "default"):
                return True
        return False

    def declared(self, tokens, partner, i):
        j, last = i + 1, len(tokens) - 1
        while j <= last:
            text = tokens[j][1]
            if text in ("=", "of", "in"):
                return
            if text in (";", ")", "}") or (tokens[j][2] and j > i + 1 and tokens[j][0] == "word"):
                break
            j = partner[j] + 1 if tokens[j][0] == "open" else j + 1
        raise SyntaxFault("constant without a value")

    def has_body(self, tokens, i):
        for j in range(i + 1, len(tokens)):
            if tokens[j][1] == "{":
                return
            if tokens[j][1] in (";", ")", "}", "="):
                break
        raise SyntaxFault("declaration without a body")

    def function(self, tokens, partner, i):
        j, last = i + 1, len(tokens) - 1
        while j <= last and tokens[j][1] != "(":
            if tokens[j][0] != "word" and tokens[j][1] not in ("*", "<", ">", ",", "extends", "="):
                raise SyntaxFault("incomplete function")
            j += 1
        if j > last or partner[j] == last:
            raise SyntaxFault("function without a body")
        after = tokens[partner[j] + 1][1]
        if after != "{" and not (self.typed and after in (":", ";")):
            raise SyntaxFault("function without a body")
        if after == ":":
            j = partner[j] + 2
            while j <= last and tokens[j][1] != "{" and tokens[j][1] != ";":
                j = partner[j] + 1 if tokens[j][0] == "open" else j + 1
            if j > last:
                raise SyntaxFault("function without a body")

    def imported(self, tokens, partner, i):
        j, last, source = i + 1, len(tokens) - 1, False
        while j <= last:
            kind, text, fresh = tokens[j]
            if kind == "str":
                source = True
                break
            if text in (";",) or kind not in ("word", "op", "open", "close"):
                break
            if text == "=" and self.typed:
                return
            if kind == "open":
                j = partner[j]
            j += 1
        if not source or tokens[j - 1][1] not in ("from", "import"):
            raise SyntaxFault("incomplete import")


class JavaScript(TypeScript):
    typed = False
    leads = words("async static get set of as from await let")
    follows = words("as of from")
    declares = words("const let var function class async default { *")


class Go(Language):
    strings = r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\[^\n]+?)\''
    keywords = words(
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range "
        "return select struct switch type var"
    )
    values = words("nil true false iota")
    prefix = words("+ - ! ^ * & <- ...")
    postfix = words("++ -- ...")
    top = words("package import func var const type")

    def allowed_pair(self, tokens, partner, i):
        before, (kind, text, _) = tokens[i - 1], tokens[i]
        if before[1] in (")", "]"):
            return kind == "word"
        if kind == "word" and before[0] == "word":
            # a name and its type: no third word beside them
            third = i > 1 and tokens[i - 2][0] == "word" and tokens[i - 2][1] not in self.keywords and not before[2]
            return not third
        return kind == "str" and before[0] == "word" and (i < 2 or tokens[i - 2][1] in ("import", "(") or before[2] or tokens[i - 2][0] in ("word", "close"))

    def structure(self, tokens, partner):
        if not tokens:
            raise SyntaxFault("no package clause")
        if tokens[0][1] != "package" or len(tokens) < 2 or tokens[1][0] != "word" or tokens[1][1] in self.keywords:
            raise SyntaxFault("no package clause")
        self.neighbours(tokens, partner)
        holder = contexts(tokens, partner)
        last = len(tokens) - 1
        for i, (kind, text, fresh) in enumerate(tokens):
            after = tokens[i + 1] if i < last else ("end", "", True)
            if holder[i] < 0 and fresh and kind != "close" and text not in self.top:
                raise SyntaxFault(f"{text!r} at the top")
            if kind == "op" and text == ";" and holder[i] >= 0 and tokens[holder[i]][1] in "([":
                raise SyntaxFault("';' inside delimiters")
            if kind == "op" and text in ("~", "?", "@", "::", "=>", "->", "?.", "??", "===", "!=="):
                raise SyntaxFault(f"stray {text!r}")
            if kind == "word" and text == "func" and holder[i] < 0:
                if after[1] == "(":
                    if partner[i + 1] == last:
                        raise SyntaxFault("incomplete func")
                    name = partner[i + 1] + 1
                else:
                    name = i + 1
                if name >= last or tokens[name][0] != "word" or tokens[name + 1][1] not in ("(", "["):
                    raise SyntaxFault("incomplete func")
            if kind == "word" and text in ("import", "package", "var", "const", "type", "if", "switch", "for", "go", "defer", "chan", "map", "range", "case", "else", "func", "struct", "interface", "select"):
                if after[0] == "end" or after[1] in (")", "]", ";", ",") or (after[1] == "}" and text not in ("case", "for", "select", "switch")):
                    if not (text in ("for", "select", "switch") and after[1] == "{"):
                        raise SyntaxFault(f"incomplete {text}")
            if kind == "word" and text == "import" and not (after[1] == "(" or after[0] == "str" or after[0] == "word" or after[1] == "."):
                raise SyntaxFault("incomplete import")

    def allowed_end(self, tokens, i):
        return False


class Rust(Language):
    comment = r"//[^\n]*"
    strings = r'b?"(?:[^"\\]|\\(?s:.))*"|b?\'(?:[^\'\\\n]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F]+\}|.))\'|r"[^"]*"'
    word = r"'?[^\W\d]\w*"
    keywords = words(
        "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self "
        "static struct super trait true type unsafe use where while async await dyn union macro_rules"
    )
    values = words("self Self super crate true false")
    prefix = words("- ! * & && || | .. ..= ... ~ ..= + ::")
    postfix = words("? .. ...")
    operators = r"<<=|>>=|\.\.=|\.\.\.|=>|->|::|\.\.|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%=<>!&|^~?:;,.@#$]"
    newline_ends = False
    top = words("pub fn use mod struct enum impl trait const static type extern unsafe async macro_rules # union")
    binary = (Language.binary - words("/ -> =>")) | words("->")

    def special(self, text, at, tokens):
        if text.startswith("/*", at):
            depth, pos = 1, at + 2
            step = re.compile(r"/\*|\*/")
            while depth:
                m = step.search(text, pos)
                if m is None:
                    raise SyntaxFault("unterminated comment")
                depth += 1 if m[0] == "/*" else -1
                pos = m.end()
            return "", pos
        if text[at] in "rb" and (m := re.compile(r"b?r(#+)\"").match(text, at)):
            end = text.find('"' + m[1], m.end())
            if end < 0:
                raise SyntaxFault("unterminated raw string")
            return "str", end + 1 + len(m[1])
        return None

    def ends_operand(self, token):
        return super().ends_operand(token) and not (token[0] == "word" and token[1].startswith("'"))

    def allowed_pair(self, tokens, partner, i):
        before, (kind, text, _) = tokens[i - 1], tokens[i]
        if kind == "word" and text.startswith("'"):
            return False
        if before[1] == "]":  # an attribute
            return partner[i - 1] > 0 and tokens[partner[i - 1] - 1][1] in ("#", "!")
        if before[0] == "word" and before[1].startswith("'"):
            return True
        return before[1] == "default" or (i > 2 and tokens[i - 2][1] == "!" and tokens[i - 3][1] == "macro_rules")

    def structure(self, tokens, partner):
        self.neighbours(tokens, partner)
        holder = contexts(tokens, partner)
        last, at = len(tokens) - 1, 0
        for i, (kind, text, fresh) in enumerate(tokens):
            after = tokens[i + 1] if i < last else ("end", "", True)
            if kind == "op" and text == ";" and holder[i] >= 0 and tokens[holder[i]][1] == "(":
                raise SyntaxFault("';' inside parentheses")
            if kind == "op" and text == "#" and after[1] not in ("[", "!"):
                raise SyntaxFault("stray '#'")
            if kind == "word" and text == "fn" and after[0] == "word":
                j = i + 2
                while j <= last and tokens[j][1] not in ("{", ";"):
                    j = partner[j] + 1 if tokens[j][0] == "open" else j + 1
                if j > last or not any(tokens[x][1] == "(" for x in range(i + 2, j)):
                    raise SyntaxFault("function without a body")
            if kind == "word" and text in self.keywords and text not in self.values | words("break return continue async await"):
                if after[0] == "end" or after[1] in (")", "]", "}", ";", ",") and not (text == "mut" or text == "type" or text == "dyn"):
                    raise SyntaxFault(f"incomplete {text}")
            if kind == "word" and text in ("struct", "enum", "trait", "mod", "impl", "use", "let", "const", "static") and holder[i] < 0:
                j = i + 1
                while j <= last and tokens[j][1] not in (";",) and not (tokens[j][1] == "{" and text not in ("use",)):
                    j = partner[j] + 1 if tokens[j][0] == "open" else j + 1
                if j > last:
                    raise SyntaxFault(f"incomplete {text}")
        while at <= last:  # items at the top
            kind, text, _ = tokens[at]
            macro = kind == "word" and at < last and tokens[at + 1][1] in ("!", "::")
            if text not in self.top and not macro:
                raise SyntaxFault(f"{text!r} at the top")
            if text == "#":
                at += 1 + (at < last and tokens[at + 1][1] == "!")
                at = partner[at] + 1 if at <= last and tokens[at][1] == "[" else last + 2
                continue
            while at <= last and tokens[at][1] != ";" and tokens[at][1] != "{":
                at = partner[at] + 1 if tokens[at][0] == "open" else at + 1
            if at > last:
                raise SyntaxFault("premature end")
            if tokens[at][1] == "{":
                at = partner[at]
                if at < last and tokens[at + 1][1] == ";":
                    at += 1
            at += 1


class Php(Language):
    comment = r"//(?:(?!\?>)[^\n])*|#(?!\[)(?:(?!\?>)[^\n])*|/\*(?s:.*?)\*/"
    strings = r'b?"(?:[^"\\]|\\(?s:.))*"|b?\'(?:[^\'\\]|\\(?s:.))*\'|`(?:[^`\\]|\\(?s:.))*`'
    word = r"\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*|\$[^\W\d]\w*|\\"
    operators = r"<=>|\*\*=|\?\?=|===|!==|<<=|>>=|\.\.\.|\?->|=>|->|::|\+\+|--|\?\?|\*\*|==|!=|<>|<=|>=|&&|\|\||\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|[-+*/%=<>!&|^~?:;,.@$#]"
    keywords = words(
        "abstract and as break callable case catch class clone const continue declare default do echo else elseif empty "
        "enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if "
        "implements include include_once instanceof insteadof interface isset list match namespace new or print private protected "
        "public readonly require require_once return static switch throw trait try unset use var while xor yield enum from"
    )
    values = words("true false null parent self")
    prefix = words("+ - ! ~ ++ -- ... & @ $ ?")
    newline_ends = False
    binary = (Language.binary - words("?? :=")) | words("?? .= -> :: ?->")

    def tokens(self, text):
        """Text outside the tags is no code; inside them the common lexer runs."""
        out, at = [], 0
        opening = re.compile(r"<\?(?:php(?=\s|$)|=)", re.IGNORECASE)
        self.open_at_end = False
        while (m := opening.search(text, at)) is not None:
            at, self.closed = m.end(), None
            echo = m[0].endswith("=")
            part = super().tokens(text[at:])
            if echo and part:
                part[0] = (part[0][0], part[0][1], True)
            out += part
            if self.closed is None:
                self.open_at_end = True
                break
            at += self.closed
            if out and out[-1][1] not in (";", "{", "}", ":"):
                out.append(("op", ";", False))
        return out

    def fragment(self, text):
        return self.tokens(text if "<?" in text else "<?php " + text)

    def special(self, text, at, tokens):
        if text.startswith("?>", at):
            self.closed = at + 2
            return "", len(text)
        if text.startswith("<<<", at) and (m := re.compile(r"<<<[ \t]*(['\"]?)(\w+)\1\n").match(text, at)):
            end = re.compile(rf"^[ \t]*{m[2]}\b", re.MULTILINE).search(text, m.end())
            if end is None:
                raise SyntaxFault("unterminated heredoc")
            return "str", end.end()
        if text[at] == "#" and text.startswith("#[", at):
            return "", at + 1
        return None

    def ends_operand(self, token):
        kind, text, _ = token
        if kind == "word":
            return text.startswith("$") or text.lower() not in self.keywords or text.lower() in self.values
        return super().ends_operand(token)

    def allowed_pair(self, tokens, partner, i):
        before, (kind, text, _) = tokens[i - 1], tokens[i]
        if kind == "word" and (text.lower() in self.keywords):
            return True
        if before[0] == "word" and not before[1].startswith("$") and kind == "word" and text.startswith("$"):
            return True  # a type and its variable
        if before[1] == ")":
            head = tokens[partner[i - 1] - 1] if partner[i - 1] > 0 else None
            return head is not None and head[1].lower() in ("if", "for", "foreach", "while", "elseif", "declare")
        if before[1] == "]":
            return partner[i - 1] == 0 or tokens[partner[i - 1] - 1][1] in (";", "{", "}", "]")
        return False

    def structure(self, tokens, partner):
        self.neighbours(tokens, partner)
        holder = contexts(tokens, partner)
        last = len(tokens) - 1
        for i, (kind, text, fresh) in enumerate(tokens):
            after = tokens[i + 1] if i < last else ("end", "", True)
            before = tokens[i - 1] if i else ("end", "", True)
            member = before[1] in ("->", "::", "?->") or after[1] == "=>"
            if kind == "op" and text == ";" and holder[i] >= 0 and tokens[holder[i]][1] in "([":
                if tokens[holder[i]][1] == "[" or holder[i] == 0 or tokens[holder[i] - 1][1].lower() != "for":
                    raise SyntaxFault("';' inside delimiters")
            if kind == "op" and text == "&" and before[0] == "op" and before[1] in ("-", ".", "+", "->", "=="):
                raise SyntaxFault("stray '&'")
            if kind != "word" or member:
                continue
            low = text.lower()
            if low in ("if", "while", "switch", "for", "foreach", "elseif", "catch") and after[1] != "(":
                raise SyntaxFault(f"incomplete {text}")
            if low in ("class", "interface", "trait", "namespace", "use", "function", "new", "try", "extends", "implements", "case", "throw", "const", "instanceof", "echo", "public", "private", "protected", "static", "abstract", "final"):
                if after[0] == "end" or after[1] in (")", "]", "}", ",") or (after[1] == ";" and low != "static"):
                    if not (low == "class" and before[1] in ("::",)) and not (low == "new"):
                        raise SyntaxFault(f"incomplete {text}")
            if low in ("class", "interface", "trait") and after[0] == "word" and not after[1].startswith("$"):
                j = i + 1
                while j <= last and tokens[j][1] not in ("{", ";", ")"):
                    j += 1
                if j > last or tokens[j][1] != "{":
                    raise SyntaxFault("declaration without a body")
            if low == "function":
                j = i + 1
                while j <= last and tokens[j][1] != "(" and (tokens[j][0] == "word" or tokens[j][1] == "&"):
                    j += 1
                if j > last or tokens[j][1] != "(":
                    raise SyntaxFault("incomplete function")
                j = partner[j] + 1
                while j <= last and tokens[j][1] not in ("{", ";"):
                    j = partner[j] + 1 if tokens[j][0] == "open" else j + 1
                if j > last:
                    raise SyntaxFault("function without a body")
            if low == "try" and after[1] == "{":
                close = partner[i + 1]
                if close == last or tokens[close + 1][1].lower() not in ("catch", "finally"):
                    raise SyntaxFault("try without catch")
        if tokens and self.open_at_end and tokens[-1][1] not in (";", "}", ":"):
            raise SyntaxFault("premature end")


class Python(Language):
    comment = r"#[^\n]*"
    _p = r"(?:[rRbBuUfFtT]|[bBfFtT][rR]|[rR][bBfFtT])?"
    strings = rf'{_p}"""(?s:(?:[^\\]|\\.)*?)"""|{_p}\'\'\'(?s:(?:[^\\]|\\.)*?)\'\'\'|{_p}"(?!"")(?:[^"\\\n]|\\(?s:.))*"|{_p}\'(?!\'\')(?:[^\'\\\n]|\\(?s:.))*\''
    operators = r"\*\*=|//=|<<=|>>=|\.\.\.|!=|:=|->|\*\*|//|<<|>>|==|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%=<>&|^~:;,.@]"
    suffix = r"[jJ]?(?!\w)"
    keywords = words(
        "False None True and as assert async await break class continue def del elif else except finally for from global if import "
        "in is lambda nonlocal not or pass raise return try while with yield"
    )
    values = words("False None True")
    prefix = words("+ - ~ * ** ... @")
    postfix = words("...")
    binary = words("= += -= *= /= //= %= **= >>= <<= &= |= ^= == != <= >= < > . % ^ + - / // ** * & | << >> := ->")
    heads = words("if elif else for while def class try except finally with")

    def logical_lines(self, text: str) -> Iterator[tuple[int, list]]:
        tokens, lines, depth, indent = self.located(text), [], 0, 0
        line: list = []
        for kind, value, fresh, column in tokens:
            if fresh and depth == 0 and line:
                yield indent, line
                line = []
            if not line:
                indent = column
            line.append((kind, value, fresh))
            if kind == "open":
                depth += 1
            elif kind == "close":
                depth -= 1
                if depth < 0:
                    raise SyntaxFault(f"unbalanced {value!r}")
        if line:
            yield indent, line

    def located(self, text: str) -> list[tuple[str, str, bool, int]]:
        out, at, fresh, size, begin = [], 0, True, len(text), 0
        while at < size:
            if at == begin and text[at] in "<=>|" and CONFLICT.match(text, at):
                raise SyntaxFault("merge conflict marker")
            m = self.scan.match(text, at)
            if m is None:
                raise SyntaxFault(f"unterminated literal or stray {text[at]!r}")
            kind = m.lastgroup
            if kind == "str" and m[0][-1:] == m[0][-2:-1] and re.fullmatch(rf"{self._p}(?:\"\"|'')", m[0]) and text[m.end() : m.end() + 1] == m[0][-1]:
                raise SyntaxFault("unterminated literal")
            if kind == "line":
                fresh, begin = True, m.end()
            elif kind not in ("blank", "comment"):
                out.append((kind, m[0], fresh, len(text[begin:at].expandtabs(8)) if fresh else 0))
                fresh = False
            elif kind == "blank" and "\n" in m[0]:
                begin = m.end()
            if kind == "str" and "\n" in m[0]:
                begin = at + m[0].rindex("\n") + 1
            at = m.end()
        return out

    def fragment(self, text):
        return [t[:3] for t in self.located(text)]

    def ends_operand(self, token):
        return super().ends_operand(token) or token[1] == "}"

    def allowed_pair(self, tokens, partner, i):
        before, (kind, text, _) = tokens[i - 1], tokens[i]
        if before[0] == "str" and kind == "str":
            return True
        return i == 1 and before[1] in ("match", "case", "type", "print") and before[1] != "print"

    newline_ends = False

    def allowed_operator(self, tokens, i):
        """The mark between parameters of a def that are given by place only and the others."""
        if tokens[i][1] != "/" or not i or tokens[i - 1][1] != "," or not tokens[i + 1 : i + 2] or tokens[i + 1][1] not in (",", ")"):
            return False
        depth = 0
        for k in range(i - 1, 1, -1):
            depth += (tokens[k][0] == "close") - (tokens[k][0] == "open")
            if depth < 0:
                return tokens[k][1] == "(" and tokens[k - 2][1] == "def"
        return False

    def allowed_end(self, tokens, i):
        text, before = tokens[i][1], tokens[i - 1][1] if i else ""
        return text in ("*", "/") and before in (",", "(") and tokens[i + 1 : i + 2] and tokens[i + 1][1] in (",", ")")

    def check(self, text):
        stack, expect, open_try, decorated = [0], False, {}, False
        heads: dict[int, str] = {}  # the head of the statement before, at each level
        for indent, line in self.logical_lines(text):
            partner = balanced(line)
            first = line[0][1]
            if expect:
                if indent <= stack[-1]:
                    raise SyntaxFault("expected an indented block")
                stack.append(indent)
            elif indent > stack[-1]:
                raise SyntaxFault("unexpected indent")
            while indent < stack[-1]:
                gone = stack.pop()
                heads.pop(gone, None)
                if open_try.pop(gone, None):
                    raise SyntaxFault("try without except")
            if indent != stack[-1]:
                raise SyntaxFault("unindent matches no outer level")
            if open_try.get(indent) and first not in ("except", "finally", "else"):
                raise SyntaxFault("try without except")
            if first in ("except", "finally"):
                if indent not in open_try:
                    raise SyntaxFault(f"{first} without try")
                open_try[indent] = False
            elif first != "else":
                open_try.pop(indent, None)
            if first == "elif" and heads.get(indent) not in ("if", "elif") or first == "else" and heads.get(indent) not in ("if", "elif", "for", "while", "except"):
                raise SyntaxFault(f"{first} without its statement")
            if decorated and first not in ("def", "class", "async", "@"):
                raise SyntaxFault("decorator without definition")
            decorated = first == "@"
            self.statement(line, partner)
            head = line[1][1] if first == "async" and len(line) > 1 else first
            heads[indent] = head
            expect = line[-1][1] == ":" and (head in self.heads or head in ("match", "case"))
            if line[-1][1] == ":" and not expect:
                raise SyntaxFault("stray ':'")
            if first == "try":
                open_try[indent] = True
        if expect:
            raise SyntaxFault("expected an indented block")
        if decorated or any(open_try.values()):
            raise SyntaxFault("premature end")

    def statement(self, line, partner):
        self.neighbours(line, partner)
        first, last = line[0][1], line[-1]
        head = line[1][1] if first == "async" and len(line) > 1 else first
        if head in self.heads and line[0][0] == "word":
            depth, colon = 0, False
            for kind, text, _ in line:
                depth += (kind == "open") - (kind == "close")
                colon |= depth == 0 and text == ":"
            if not colon:
                raise SyntaxFault("expected ':'")
        if line[0][0] in ("num", "str") and len(line) > 1 and line[1][1] == "=":
            raise SyntaxFault("a literal is no target")
        for i, (kind, text, _) in enumerate(line):
            if text == "(" and kind == "open" and i and (line[i - 1][0] == "word" and self.ends_operand(line[i - 1]) or line[i - 1][1] in (")", "]")):
                self.arguments(line, partner, i, head == "def" and i < 4)
        if head == "def" and not (len(line) > 3 and any(t[1] == "(" for t in line)):
            raise SyntaxFault("incomplete def")
        if first == "import" and len(line) < 2 or first == "from" and not any(t[1] == "import" for t in line[:-1]):
            raise SyntaxFault("incomplete import")
        for i, (kind, text, _) in enumerate(line):
            if kind != "word" or text not in self.keywords or text in self.values:
                continue
            after = line[i + 1][1] if i + 1 < len(line) else ""
            before = line[i - 1] if i else None
            if text in ("and", "or", "in", "is", "not", "as", "lambda", "assert", "del", "import", "global", "nonlocal", "class", "def", "await", "for", "with", "while", "if", "elif", "from"):
                if after in ("", ")", "]", "}", ",", ":") and not (text == "lambda" and after == ":") and not (text == "from" and after == ""):
                    raise SyntaxFault(f"incomplete {text}")
            if text in ("and", "or", "is", "in") and (before is None or not self.ends_operand(before)) and not (text == "in" and before and before[1] == "not"):
                raise SyntaxFault(f"{text!r} without a left side")
            if i and text in ("return", "def", "class", "while", "try", "with", "raise", "import", "pass", "break", "continue", "del", "assert", "global") and before[1] not in (":", ";", "async"):
                if not (text == "import" and first == "from"):
                    raise SyntaxFault(f"{text!r} inside a statement")
        if last[1] == "." or last[1] == ",":
            if last[1] == ".":
                raise SyntaxFault("premature end")


    def arguments(self, line, partner, begin, defines: bool):
        """A plain argument may not follow a named one, nor a parameter without a default one that has it."""
        i, named, first, own = begin + 1, False, line[begin + 1], False
        while i <= partner[begin]:
            text = line[i][1]
            if text == "," or i == partner[begin]:
                if first[1] in ("*", "**"):
                    named = named and not defines
                elif named and not own and first[1] not in (",", ")", "/"):
                    raise SyntaxFault("plain argument after a named one")
                named |= own
                first, own = line[i + 1] if i < partner[begin] else None, False
            elif text == "lambda":
                return
            own |= text == "="
            i = partner[i] + 1 if line[i][0] == "open" else i + 1


LANGUAGES = {"typescript": TypeScript(), "javascript": JavaScript(), "python": Python(), "go": Go(), "rust": Rust(), "php": Php()}


def usual_name(language: str) -> str:
    """A language's usual name, whatever its case."""
    low = language.strip().lower()
    return ALIASES.get(low, low)


def fault(text: str | None, language: str | None) -> str | None:
    """Why the text is no valid source of the language; None if it is, is blank, or can't be judged."""
    checker = LANGUAGES.get(language or "")
    if checker is None or text is None or not text.strip():
        return None
    try:
        checker.check(text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
    except SyntaxFault as found:
        return str(found)
    return None


def language_of(language: Column, file: Column) -> Column:
    """The given language in lower case under its usual name; where it is null or blank, the file's extension decides."""
    def mapped(column, table):
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[column]

    given = F.nullif(F.lower(F.trim(language)), F.lit(""))
    extension = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(mapped(given, ALIASES), given, mapped(extension, EXTENSIONS))


def checked_files(files: DataFrame) -> DataFrame:
    """(repository, commit_hash, file, language, judged, fault) of the latest content per key.

    Key: repository, commit_hash, file; of several rows the latest captured_at counts, then the latest
    loaded_at, then the larger content. ``fault`` is null for valid, empty, blank and null contents;
    files of a language without a lexer aren't judged. Rows with a null key part are kept under it; other columns are ignored.
    """
    key = ["repository", "commit_hash", "file"]
    row = F.struct("captured_at", "loaded_at", "content", "language").alias("row")
    latest = files.select(*key, row).groupBy(*key).agg(F.max("row").alias("row"))
    latest = latest.select(*key, language_of(F.col("row.language"), F.col("file")).alias("language"), F.col("row.content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fault(t, l) for t, l in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.string())], names=[*key, "language", "fault"])

    judged = F.col("language").isin(*LANGUAGES).alias("judged")
    told = latest.mapInArrow(run, "repository string, commit_hash string, file string, language string, fault string")
    return told.select(*key, "language", F.coalesce(judged, F.lit(False)).alias("judged"), "fault")


def broken_files(files: DataFrame) -> DataFrame:
    """Keys of the files with a syntax error, and the error."""
    return checked_files(files).where("fault is not null").select("repository", "commit_hash", "file", "language", "fault")


def broken_rates(files: DataFrame) -> DataFrame:
    """Files, those not judged for want of a lexer, broken files, and their rate among the judged, per repository and
    language, per repository (null language) and in all. The rate is null where no file is judged."""
    return (
        checked_files(files)
        .rollup("repository", "language")
        .agg(F.count("*").alias("files"), F.count_if(~F.col("judged")).alias("unjudged"), F.count("fault").alias("broken"), F.grouping_id().alias("level"))
        .withColumn("rate", F.when(F.col("files") > F.col("unjudged"), F.round(F.col("broken") / (F.col("files") - F.col("unjudged")), 6)))
    )
