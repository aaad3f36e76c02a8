"""A renderer that tests name in an option; executors import it."""


def render(content: bytes, page: int, dpi: int) -> tuple[bytes, int, int]:
    return content[:1] * (page + 1) * 2, 2, page + 1
