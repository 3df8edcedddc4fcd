"""Errors that users can act on."""


class BoostError(ValueError):
    """Any refusal of this library."""


class InvalidParameter(BoostError):
    """A parameter, or a combination of them, that isn't supported."""


class InvalidData(BoostError):
    """Data that a model can't be made from or applied to."""


class IncompatibleModel(BoostError):
    """A model that doesn't fit the request."""
