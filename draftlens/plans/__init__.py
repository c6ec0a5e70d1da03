"""Named queries over a data folder, each with its SQL twin where one exists."""


def load():
    """The filled register."""
    from draftlens.plans import lifecycles, nested, registry, relational, scores, texts  # noqa: F401

    return registry
