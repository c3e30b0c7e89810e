"""python -m sparrowmill plan|inspect|tokenize|subset|split|quantize|validate|embed|bench: the verbs of the command line."""

from __future__ import annotations

import argparse

from .operators import quantize, schedule, split
from .session import get_session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("sparrowmill")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, about in (("plan", "tiers of a table's sources"), ("inspect", "rows by source, with a total"), ("split", "held-out ids by source")):
        s = sub.add_parser(verb, help=about)
        s.add_argument("table", help="Parquet with a column source")
        s.add_argument("--id", default="doc_id")
        s.add_argument("--out", help="where to write the result")
        s.add_argument("--exclude", nargs="*", default=[])
    q = sub.add_parser("quantize", help="an artifact from a weight table")
    q.add_argument("table", help="Parquet of token_id, vec")
    q.add_argument("out")
    q.add_argument("--dim", type=int, required=True)
    q.add_argument("--bits", type=int, choices=(2, 4, 8, 32), required=True)
    q.add_argument("--axis", choices=("row", "dim"), default="row")
    v = sub.add_parser("validate", help="reads an artifact and checks its sizes")
    v.add_argument("path")
    t = sub.add_parser("tokenize", help="appends token ids of a table (source, row_idx, query, document) to a token table")
    t.add_argument("table")
    t.add_argument("out", help="the token table")
    t.add_argument("--tokenizer", required=True, help="a tokenizer file")
    u = sub.add_parser("subset", help="the rows that a tier takes of a token table")
    u.add_argument("path", help="the token table")
    u.add_argument("tiers", help="the tier map, a JSON file")
    u.add_argument("tier")
    u.add_argument("--side", choices=("query", "document"), help="only this side's ids")
    u.add_argument("--rows", type=int, default=20)
    for verb, about in (("embed", "vectors of a table's texts"), ("bench", "how fast that goes")):
        e = sub.add_parser(verb, help=about)
        e.add_argument("artifact")
        e.add_argument("table", help="Parquet with a column text")
        e.add_argument("--tokenizer", required=True, help="a tokenizer file")
        e.add_argument("--out", help="where to write the vectors")
    a = p.parse_args(argv)
    spark = get_session()
    if a.verb == "quantize":
        from .model import quantize_table

        print(quantize.variant(a.bits, a.axis), quantize_table(spark.read.parquet(a.table), a.out, a.dim, a.bits, a.axis))
    elif a.verb == "tokenize":
        from .operators.embed import wordpiece
        from .sources.tables import append_tokens

        x = spark.read.parquet(a.table)
        for side, ids in (("query", "query_ids"), ("document", "doc_ids")):
            x = wordpiece(x, a.tokenizer, side, ids)
        print(append_tokens(x, a.out, a.tokenizer), "rows appended")
    elif a.verb == "subset":
        from .sources.files import read_tiers
        from .sources.tables import open_tier

        x = open_tier(spark, a.path, read_tiers(spark, a.tiers), a.tier)
        columns = {"query": ["query_ids"], "document": ["doc_ids"], None: ["query_ids", "doc_ids"]}[a.side]
        x.select("source", "row_idx", *columns).orderBy("source", "row_idx").show(a.rows, False)
    elif a.verb in ("embed", "bench"):
        import time

        from .model import Model, Tokenizer
        from .operators.embed import counters, spread

        m, t = Model.load(spark, a.artifact), Tokenizer(path=a.tokenizer)
        x = m.embed_documents(spread(spark.read.parquet(a.table)), t)
        if a.verb == "embed":
            x.drop("ids").write.mode("overwrite").parquet(a.out) if a.out else x.drop("ids", "text").show(20)
        else:
            began = time.time()
            n = counters(x.select("ids", "embedding").where("size(embedding) > 0")).first()
            took = time.time() - began
            print(n.asDict() | {"seconds": round(took, 3), "docs_per_s": round(n.n_docs / took, 1), "tokens_per_s": round((n.n_tokens or 0) / took, 1)})
    elif a.verb == "validate":
        from .model import Model

        m = Model.load(spark, a.path)
        print(m.variant, m.vocab_size, m.dim, m.metadata)
    else:
        df = spark.read.parquet(a.table)
        sizes = schedule.sizes(df)
        if a.verb == "plan":
            out = schedule.tiers(schedule.usable(sizes, tuple(a.exclude)))
        elif a.verb == "inspect":
            out = sizes.rollup("source").sum("size")
        else:
            out = split.stratified_split(df, a.id)
        out.write.mode("overwrite").parquet(a.out) if a.out else out.show(50, False)


if __name__ == "__main__":
    main()
