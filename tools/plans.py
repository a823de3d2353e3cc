"""Write the physical plan trees of the headline queries to PLANS.md."""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagesift.plans import catalog  # noqa: E402
from pagesift.session import local_session  # noqa: E402

KEYS = ["relevant_articles", "profile_similarity", "tfidf", "url_join", "parser_tree", "config_verdict",
        "stage_history", "config_latest", "rule_lookup", "frontier_expand"]


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n\n")[0]
    return head.replace("== Physical Plan ==\n", "")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    qs = catalog.queries()
    out = ["# Physical plans", "", f"`explain('formatted')` trees at `{sf}`, local session. Regenerate with "
           "`python tools/plans.py`.", ""]
    for k in KEYS:
        out += [f"## {k}", "", "```", tree(qs[k](spark, sf)).rstrip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
