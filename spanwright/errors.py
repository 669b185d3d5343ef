"""Errors with stable exit codes."""


class SpanError(Exception):
    exit_code = 1


class InvalidInput(SpanError):
    exit_code = 2


class UnprocessableMedia(SpanError):
    exit_code = 3


class Misconfigured(SpanError):
    exit_code = 4


class BudgetExceeded(SpanError):
    exit_code = 5


class BackendUnavailable(SpanError):
    exit_code = 6
