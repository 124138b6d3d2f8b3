"""Exceptions of the engine. Row-level problems become quarantine rows; these are raised for whole calls and on request."""


class GraphError(RuntimeError):
    """Base of all errors of the engine."""


class MissingDependency(GraphError):
    """An optional library or program is not installed."""


class ResponseError(GraphError):
    """An extractor gave no usable answer."""


class RenderError(GraphError):
    """DOT text could not be written or rendered."""


class ValidationFailed(GraphError):
    """A graph failed validation; `report` holds the issues."""

    def __init__(self, report):
        self.report = report
        issues = getattr(report, "issues", report)
        super().__init__("; ".join(issues))


class CastingFailed(GraphError):
    """A casting failed validation; `issues` holds the texts."""

    def __init__(self, issues):
        self.issues = tuple(issues)
        super().__init__("; ".join(self.issues))
