"""The same three calls as tools of a server; the protocol comes from an optional package."""

from __future__ import annotations

from loomspark.plans import api, cli


def search_tool(query: str, path: str = api.FOLDER, top_k: int = 5) -> str:
    """Finds passages, with headings above them and marks where something is left out."""
    return "\n\n".join(cli.result_blocks(api.search(query, path, top_k=top_k))) or "No results found."


def index_tool(path: str = api.FOLDER, file: str | None = None, glob: str = "**/*.md") -> str:
    """Indexes a folder, or one file of it."""
    return cli.file_line(file, api.update_file(api.open_store(path), file)) if file else cli.index_line(api.index(path, glob=glob))


def status_tool(path: str = api.FOLDER) -> str:
    """Tells what is indexed."""
    info = api.status(path)
    return cli.status_lines(info) if info["files"] else "No indexed files. Index a folder first."


def serve() -> None:
    """Runs the tools over standard input and output, where the protocol package is installed."""
    from mcp.server.fastmcp import FastMCP

    server = FastMCP("loomspark")
    for tool in (search_tool, index_tool, status_tool):
        server.tool()(tool)
    server.run(transport="stdio")
