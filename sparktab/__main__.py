"""Command line: ``python -m sparktab COMMAND ...``.

compress [--store [DIR]] [-q] FILE|-|URL  the document on standard output, notes on standard error
decompress [--store [DIR]] FILE|-    the JSON value (keys in order)
fsck [--documents FILE...] [DIR]     counts of a store, broken cells, leaked objects, entries that no given document uses
list [--objects] [DIR]               the documents of a store, or its objects, in order
gc [--delete] [DIR]                  objects that no document reaches; with --delete they go
export [--store DIR] DOCUMENT FILE   a document's index and objects as JSON, a line for each part
import [--store DIR] FILE            such a file into a store
fetch [--store DIR] DOCUMENT ID... [--query Q]  stored values
web [--port N]                       a page on this machine
tools [--store DIR]                  JSON-RPC on standard input and output

DIR is that of SPARKTAB_STORE, or .sparktab in the home directory, unless given.

Exit status: 0 fine, 1 broken cells or refused bundles, 2 called wrong or empty input.
"""

from __future__ import annotations

import argparse
import os
import sys

#: How many lines of a list are shown.
SHOWN = 20


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def default_root() -> str:
    return os.environ.get("SPARKTAB_STORE") or os.path.join(os.path.expanduser("~"), ".sparktab")


def _input(name: str) -> bytes:
    if name == "-":
        return sys.stdin.buffer.read()
    if name.startswith(("http://", "https://")):
        from .sources.remote import fetched

        raw, error = fetched(name)
        if error:
            _say(error)
        return raw or b""
    with open(name, "rb") as f:
        return f.read()


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _compress(args) -> int:
    raw = _input(args.file)
    if not raw:
        _say("the input is empty")
        return 2
    from .operators.store import Store
    from .plans.compress import compress

    spark = _session()
    done = compress(spark.createDataFrame([("it", raw)], "doc_id string, raw binary"), with_store=args.store is not None)
    row = done.documents.first()
    if args.store is not None:
        Store(spark, args.store).commit(done.moved, done.ids)
    out = raw if row.status == "unchanged" else row.document.encode()
    sys.stdout.buffer.write(out if row.status == "unchanged" or out.endswith(b"\n") else out + b"\n")
    if not args.quiet:
        if row.dropped:
            _say(f"dropped, not recoverable: {', '.join(row.dropped)}")
        if row.note:
            _say(row.note)
        _say(f"{row.before} -> {row.after} tokens ({row.saved}% saved)" + (f", {row.held} values stored" if row.held else ""))
    return 0


def _decompress(args) -> int:
    from .operators.store import Store
    from .plans.compress import decompress

    spark = _session()
    documents = spark.createDataFrame([("it", _input(args.file).decode())], "doc_id string, document string")
    row = decompress(documents, Store(spark, args.store) if args.store else None).first()
    if row.error:
        _say(row.error)
        return 2
    print(row.canon)
    return 0


def _list(title: str, rows, *columns: str) -> int:
    """Print how many rows there are and the first of them."""
    n = rows.count()
    print(f"{title}: {n}")
    for r in rows.orderBy(*columns).limit(SHOWN).collect():
        print("  " + " ".join(r[c] for c in columns))
    if n > SHOWN:
        print(f"  ... and {n - SHOWN} more")
    return n


def _fsck(args) -> int:
    from .operators import store

    held = store.Store(_session(), args.store)
    print(f"{held.index.select('doc_id').distinct().count()} documents, {held.index.count()} cells, {held.objects.count()} objects")
    broken = _list("BROKEN", store.broken(held.index, held.objects), "doc_id", "cell_id", "name", "problem")
    _list("LEAKED", store.leaked(held.index, held.objects), "name")
    if args.documents:
        from .sources.documents import used_cells

        given = held.spark.createDataFrame([(_input(name).decode(),) for name in args.documents], "document string")
        used = used_cells(given)
        ours = held.index.join(used.select("doc_id").distinct(), "doc_id", "left_semi")
        _list("ORPHANED", store.orphaned(ours, used), "doc_id", "cell_id", "name")
    return 1 if broken else 0


def _listing(args) -> int:
    from .operators.store import Store

    held = Store(_session(), args.store)
    for r in (held.names() if args.objects else held.documents()).toLocalIterator():
        print(r[0])
    return 0


def _gc(args) -> int:
    from .operators.store import Store

    n = Store(_session(), args.store).collect(args.delete)
    print(f"{n} objects {'deleted' if args.delete else 'can be deleted'}")
    return 0


def _export(args) -> int:
    from pyspark.sql import functions as F

    from .operators import store

    held = store.Store(_session(), args.store)
    if not held.has_document(args.document):
        _say(f"no document {args.document}")
        return 2
    parts = store.bundles(held.index.filter(F.col("doc_id") == args.document), held.objects).orderBy("part").collect()
    if any(r.bundle is None for r in parts):
        _say("a stored value is missing or has changed")
        return 1
    with open(args.file, "w") as f:
        f.writelines(r.bundle + "\n" for r in parts)
    return 0


def _import(args) -> int:
    from .operators.store import Store

    spark = _session()
    refused = Store(spark, args.store).import_bundles(spark.createDataFrame([(x,) for x in _input(args.file).decode().split("\n") if x.strip()], "bundle string")).collect()
    for r in refused:
        _say(f"refused: {r.problem}")
    return 1 if refused else 0


def _fetch(args) -> int:
    from .operators.fetch import fetch
    from .operators.store import Store

    spark = _session()
    held = Store(spark, args.store)
    asked = spark.createDataFrame([("it", args.document, args.ids)], "request string, document string, ids array<string>")
    for r in fetch(asked, held.index, held.objects, args.query).orderBy("pos").collect():
        print(f"[{r.cell_id}] {r.state}" + (f"\n{r.content}" if r.content is not None else "") + "\n")
    return 0


def _web(args) -> int:
    from .serving import HOST, web_server

    with web_server(_session(), args.port) as server:
        _say(f"http://{HOST}:{server.server_address[1]}/")
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
    return 0


def _tools(args) -> int:
    from .serving import serve_tools

    serve_tools(_session(), args.store)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparktab", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, *fields: str):
        own = commands.add_parser(name)
        for f in fields:
            own.add_argument(f)
        own.set_defaults(run=run)
        return own

    def rooted(own) -> None:
        own.add_argument("--store", default=default_root())

    one = command("compress", _compress, "file")
    one.add_argument("--store", nargs="?", const=default_root())
    one.add_argument("-q", "--quiet", action="store_true")
    command("decompress", _decompress, "file").add_argument("--store", nargs="?", const=default_root())
    one = command("fsck", _fsck)
    one.add_argument("store", nargs="?", default=default_root())
    one.add_argument("--documents", nargs="+", default=[])
    one = command("list", _listing)
    one.add_argument("store", nargs="?", default=default_root())
    one.add_argument("--objects", action="store_true")
    one = command("gc", _gc)
    one.add_argument("store", nargs="?", default=default_root())
    one.add_argument("--delete", action="store_true")
    rooted(command("export", _export, "document", "file"))
    rooted(command("import", _import, "file"))
    one = command("fetch", _fetch, "document")
    one.add_argument("ids", nargs="+")
    one.add_argument("--query")
    rooted(one)
    command("web", _web).add_argument("--port", type=int, default=8737)
    rooted(command("tools", _tools))
    args = parser.parse_args(argv)
    try:
        status = args.run(args)
        sys.stdout.flush()
    except BrokenPipeError:
        # A reader that stops early ends the program quietly; nothing is left to flush at the end.
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return 0
    return status


if __name__ == "__main__":
    sys.exit(main())
