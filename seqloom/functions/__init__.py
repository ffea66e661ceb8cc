from seqloom.functions import scalar, text, uniform  # noqa: F401
