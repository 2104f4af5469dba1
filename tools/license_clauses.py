"""python tools/license_clauses.py FOLDER: write credence/llm/licenses.json from the
license texts <label>.<name>.txt of a folder.

Paragraphs are clauses; long ones are cut at ends of sentences. Headings (under eight
words) and lines of copyright holders are left out. A clause that names its license
requires that name. A clause that the text of another license meets as well requires
the shortest run of up to four words that those texts don't hold; without any it can't
tell the two apart and is left out, and its number is printed."""

import json
import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from credence.llm.license_join import _WORDS, Clause, Matcher  # noqa: E402

LEAST, MOST = 8, 60
NAMES = {"gpl": ["gnu general public license"], "lgpl": ["gnu lesser general public license", "gnu library general public license"],
         "agpl": ["gnu affero general public license"], "apache": ["apache license"], "mpl": ["mozilla public license"], "gfdl": ["gnu free documentation license"]}


def cut(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def parts(text: str) -> list[str]:
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = " ".join(x for x in paragraph.split("\n") if not re.match(r"\s*Copyright (\(C\)|©|\[)", x, re.I))
        held = ""
        for piece in re.split(r"(?<=[.;:])\s+", paragraph) if len(cut(paragraph)) > MOST else [paragraph]:
            held = f"{held} {piece}".strip()
            if len(cut(held)) >= 2 * LEAST:
                out.append(held)
                held = ""
        if len(cut(held)) >= LEAST:
            out.append(held)
    return [" ".join(x.split()) for x in out]


def main(folder: str) -> None:
    texts = [(p.name.split(".")[0], p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(folder).glob("*.txt"))]
    plain = sorted({(label, part) for label, text in texts for part in parts(text)})
    named = []
    for label, part in plain:
        held = f" {b' '.join(cut(part)).decode()} "
        named.append((label, part, [n for n in NAMES.get(label, []) if f" {n} " in held]))
    rivals = {}
    words = [(label, cut(text)) for label, text in texts]
    matcher = Matcher([Clause.of(*c) for c in named], {})
    for label, some in words:
        for i in matcher.met(some):
            if matcher.clauses[i].label != label:
                rivals.setdefault(i, []).append(b" " + b" ".join(some) + b" ")
    out, lost = [], Counter()
    for i, (label, part, required) in enumerate(named):
        own = cut(part)
        runs = (b" ".join(own[k:k + n]) for n in range(1, 5) for k in range(len(own) - n + 1))
        if i in rivals:
            tells = next((r for r in runs if not any(b" " + r + b" " in t for t in rivals[i])), None)
            if tells is None:
                lost[label] += 1
                continue
            required = [*required, tells.decode()]
        out.append([label, part, required])
    target = Path(__file__).resolve().parent.parent / "credence/llm/licenses.json"
    target.write_text("[\n" + ",\n".join(json.dumps(c, ensure_ascii=False) for c in out) + "\n]\n", encoding="utf-8")
    print(len(out), "clauses", dict(Counter(c[0] for c in out)), "left out", dict(lost))


if __name__ == "__main__":
    main(sys.argv[1])
