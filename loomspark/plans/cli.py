"""Command line: index, search, status."""

from __future__ import annotations

import argparse
import json

from loomspark.plans import api


def result_blocks(results: list[dict]) -> list[str]:
    return [f"--- Result {i} (score: {r['score']:.4f}) ---\nFile: {r['file_path']}\n{r['context']}" for i, r in enumerate(results, 1)]


def file_line(file: str, result: dict) -> str:
    return f"{file}: {result['status']} ({result.get('new_chunks', 0)} chunks, {result.get('new_chunksets', 0)} chunksets)"


def index_line(result: dict) -> str:
    return "Indexed {files_indexed} files: {chunks_created} chunks, {chunksets_created} chunksets".format(**result)


def status_lines(info: dict) -> str:
    rows = [("Files", len(info["files"])), ("Chunks", info["total_chunks"]), ("Chunksets", info["total_chunksets"]), ("Semantic", "yes" if info["has_embeddings"] else "no")]
    return "\n".join([*(f"{k + ':':<11}{v}" for k, v in rows), *(f"  - {f}" for f in info["files"])])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomspark", description="Search documents with the structure around what is found.")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("path", nargs="?", default=api.FOLDER)
    one.add_argument("--file")
    one.add_argument("--glob", default="**/*.md")
    two = commands.add_parser("search")
    two.add_argument("query")
    two.add_argument("--path", default=api.FOLDER)
    two.add_argument("--top", "--top-k", dest="top", type=int, default=5)
    two.add_argument("--json", dest="as_json", action="store_true")
    three = commands.add_parser("status")
    three.add_argument("--path", default=api.FOLDER)
    for p in (one, two, three):
        p.add_argument("--db")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "index" and a.file:
        print(file_line(a.file, api.update_file(api.open_store(a.path, a.db), a.file)))
    elif a.command == "index":
        print(index_line(api.index(a.path, a.db, a.glob)))
    elif a.command == "search":
        found = api.search(a.query, a.path, a.db, a.top)
        if a.as_json:
            print(json.dumps(found, indent=2))
        elif not found:
            print("No results found.")
        else:
            print("\n" + "\n\n".join(result_blocks(found)))
    else:
        info = api.status(a.path, a.db)
        print(status_lines(info) if info["files"] else "No indexed files. Run: loomspark index")


if __name__ == "__main__":
    main()
