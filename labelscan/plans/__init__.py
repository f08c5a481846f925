from . import catalogue, images, intake, labels, reports, stores  # noqa: F401  (they register their queries)
