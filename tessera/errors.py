"""What the engine raises for inputs it refuses."""


class TesseraError(Exception):
    """Base of all."""


class PageNotFound(TesseraError):
    """No page or alias of that name."""


class PageExists(TesseraError):
    """A new page would replace one."""


class SlugError(TesseraError, ValueError):
    """A name that no page can have."""


class ConflictError(TesseraError):
    """An alias or identity that another row holds."""
