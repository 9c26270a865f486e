"""Every regular expression, in explicit classes that mean the same to Java, RE2 and Python."""

# The kinds of tokens, in the order in which they are tried. Words take combining marks along; in parity
# mode they do not, and URLs and numbers end as the reference's code (not its documentation) ends them.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_HEAD = {False: r"https?://[^\s]*[^\s.,!?;:]|www\.[^\s]*[^\s.,!?;:]", True: r"https?://[^\s.,!?;:]+|www\.[^\s.,!?;:]+"}
_NUMBER = {False: r"\p{Nd}[\p{Nd},._:/\-]*\p{Nd}%?|\p{Nd}+%?", True: r"\p{Nd}[\p{Nd},._:/\-]*\p{Nd}|\p{Nd}+%?"}
_LETTERS = {False: r"\p{L}\p{M}\p{N}_", True: r"\p{L}\p{N}_"}


def token_pattern(parity: bool = False, email_guard: bool = True) -> str:
    """Ordered alternatives of one token. email_guard: an e-mail must end at punctuation, blank or the text's end (RE2 cannot look ahead)."""
    w = _LETTERS[parity]
    email = EMAIL + (r"(?=[.,!?;:\s]|$)" if email_guard else "")
    return "|".join([_HEAD[parity], email, r"#[A-Za-z0-9_]+", r"@[A-Za-z0-9_]+", _NUMBER[parity], r"[A-Za-z]+(?:'[A-Za-z]+)+", f"[{w}]+", rf"[^{w}\s]"])


PUNCTUATION = r"^[^\p{L}\p{M}\p{N}_\s]+$"
DIGITS = r"^\p{Nd}+$"
DEVANAGARI = r"[\x{0900}-\x{097F}]"
ALPHA = r"^\p{L}+$"
SPLIT = r"[ \t\n\r\f]+"
# Tokens that no spelling rule may touch.
ARTIFACT = (
    r"^#\S+$|^@\S+$|^https?://\S+$|^www\.\S+$|^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$|\d[\d,._:/\-]\d"
    r"|[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1FA00}-\x{1FA9F}\x{2764}\x{2665}\x{2660}\x{2663}\x{2666}]|:\)|:\(|:D|;\)|:-\)|:\||:P|XD|<3"
)
PROTECTED = r"https?://\S+|www\.\S+|@\w+|#\w+|\d[\d,\.]*"
PROPER = r"^[A-Z][a-z]+$"
LABELS = "EN|HI|HI_ROM|HI_DEV|UNK"
# Control markers, in the order in which they are removed; labels of three parts and both inline forms included.
MARKERS = {
    "switch_bracket": rf"\[SWITCH(?:_(?:{LABELS})_(?:{LABELS}))?\]",
    "switch_xml": r"<SWITCH[^>]*>",
    "switch_inline": rf"\|\|\|(?:{LABELS})→(?:{LABELS})\|\|\||⟨(?:{LABELS})→(?:{LABELS})⟩",
    "lang_tag_xml_open": rf"<(?:{LABELS})>",
    "lang_tag_xml_close": rf"</(?:{LABELS})>",
    "lang_tag_inline": rf"\|(?:{LABELS})\b",
    "lang_tag_prefix": rf"\[(?:{LABELS})\]\s*",
    "lang_tag_suffix": rf"\s*\[(?:{LABELS})\]",
    "dev_prefix": r"\bDEV:",
    "tr_prefix": r"\bTR:",
}
# The same in parity mode.
MARKERS_PARITY = {k: v for k, v in MARKERS.items() if k != "switch_inline"} | {"switch_bracket": r"\[SWITCH(?:_[A-Z]+_[A-Z]+)?\]"}
SWITCH_MARKER = r"\[SWITCH(?:_[A-Z0-9_]+)?\]|<SWITCH\b[^>]*>|⟨[A-Z_]+→[A-Z_]+⟩|\|\|\|[A-Z_]+→[A-Z_]+\|\|\|"
# Spelling repairs of unknown Hindi words, in order.
REPAIRS = [("ach+a+", "accha"), ("nah+i+", "nahi"), ("yaa+r+", "yaar"), ("bahu+t", "bahut"), ("samj+h", "samajh"), ("kyu+n?", "kyun"), ("haa+n", "haan"), ("the+k", "theek")]
