"""Pattern fragments that give Java regular expressions the meaning JavaScript gives them."""

# What JavaScript counts as white space, for use inside a class.
SPACES = r"\t-\r\x20\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACE = f"[{SPACES}]"
#: ASCII word borders; Java's own are Unicode-aware.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
FOLD = "(?iu)"
CYRILLIC = r"[\x{0400}-\x{04ff}]"
