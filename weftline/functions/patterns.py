"""Pieces from which patterns are put together."""

W, S = r"\s+", r"\s*"  # white space, some or none
H = r"[ \t]"  # within a line
N, NAME = r"(\w+)", r"[A-Za-z_]\w*"  # a word that is taken; an identifier
ANY = r"[\s\S]*?"  # as little as possible, over lines
AN = "a-zA-Z0-9"
PKG = rf"([{AN}\-_]+)"  # a package's name, taken
TAKEN = r"([^<]+)"  # text of an element, taken
ARGS = r"\(([^)]*)\)"  # a list in parentheses, taken
DIGITS = "[0-9]+"
LET = "(?:const|let|var)"
LOW = "a-z0-9"
_Q = "['\"]"
QUOTED = f"{_Q}([^{_Q[1:]}+){_Q}"  # a string, taken
BARS = r"[\s│|]"  # what stands before a branch of a tree


def maybe(word: str) -> str:
    """A word with white space after it, or nothing."""
    return rf"(?:{word}{W})?"
