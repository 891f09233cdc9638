"""A synthetic project tree of any size, the same for the same seed."""

from __future__ import annotations

import json
from pathlib import Path

VERBS = ("load", "save", "build", "check", "merge", "route", "score")
OBJECTS = ("Account", "Contact", "Opportunity", "Lead")


class Lcg:
    """Linear congruential numbers modulo 2^32."""

    def __init__(self, seed: int):
        self.state = seed % 2**32

    def below(self, n: int) -> int:
        self.state = (1664525 * self.state + 1013904223) % 2**32
        return self.state * n >> 32


def generate(root: str, classes: int, seed: int = 1) -> dict[str, int]:
    """Writes ``classes`` classes of 5 to 10 methods each, that call a peer a third of the way on; 30 % extend their
    predecessor; two handlers with triggers. Returns counts."""
    base, rng = Path(root, "force-app/main/default"), Lcg(seed)
    for d in ("classes", "triggers"):
        (base / d).mkdir(parents=True, exist_ok=True)
    Path(root, "sfdx-project.json").write_text(json.dumps({"packageDirectories": [{"path": "force-app", "default": True}], "sourceApiVersion": "60.0"}))
    n_methods = 0
    for i in range(1, classes + 1):
        peer = (i + classes // 3) % classes + 1
        extends = f" extends Class{i - 1}" if i > 1 and rng.below(10) < 3 else ""
        body = []
        for m in range(1, 6 + rng.below(6)):
            verb, obj = VERBS[rng.below(len(VERBS))], OBJECTS[rng.below(len(OBJECTS))]
            work = f"List<{obj}> rows = [SELECT Id, Name FROM {obj} WHERE Name != null];" if m == 1 else f"Class{peer}.run();"
            body.append(f"    public static void {verb}_{m}(Integer n) {{\n        {work}\n    }}\n")
            n_methods += 1
        body.append("    public static void run() { Class%d helper = new Class%d(); }\n" % (peer, peer))
        (base / f"classes/Class{i}.cls").write_text(f"public virtual class Class{i}{extends} {{\n{''.join(body)}}}\n")
        n_methods += 1
    for obj in OBJECTS[:2]:
        (base / f"classes/{obj}Handler.cls").write_text(f"public class {obj}Handler {{\n    public static void handle() {{ Class1.run(); }}\n}}\n")
        (base / f"triggers/{obj}Trigger.trigger").write_text(f"trigger {obj}Trigger on {obj} (before insert, after update) {{\n    {obj}Handler.handle();\n}}\n")
        n_methods += 1
    return {"classes": classes + 2, "methods": n_methods, "triggers": 2}
