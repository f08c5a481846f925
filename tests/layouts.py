"""Word layouts of extraction tests: one list per line; ``w@c`` is word w read with confidence c."""


def words(*lines: str, confidence: float = 90.0) -> list[dict]:
    out = []
    for n, line in enumerate(lines):
        left = 10
        for token in line.split():
            text, _, conf = token.rpartition("@") if "@" in token and token.rpartition("@")[2].isdigit() else (token, "", confidence)
            width = max(8, 8 * len(text))
            out.append({"text": text, "conf": float(conf), "left": left, "top": (10 + n) * 20, "width": width, "height": 12, "provider": None, "original_text": None})
            left += width + 5
    return out
