"""The error that a user can put right."""


class LecternError(Exception):
    """An input or option that the user can fix; its message says how."""
