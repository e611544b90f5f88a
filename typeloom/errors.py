"""Errors and warnings that are part of the interface."""


class DuplicateTagsWarning(UserWarning):
    pass


class StandardTagsChangedWarning(UserWarning):
    pass


class UpgradeSchemaWarning(UserWarning):
    pass


class OutdatedSchemaWarning(UserWarning):
    pass


class IndexTagRemovedWarning(UserWarning):
    pass


class TypingInfoMismatchWarning(UserWarning):
    pass


class TypeConversionWarning(UserWarning):
    pass


class ParametersIgnoredWarning(UserWarning):
    pass


class NotTypedWarning(UserWarning):
    pass


class SparseDataWarning(UserWarning):
    pass


class TypeConversionError(Exception):
    pass


class ColumnNotPresentError(KeyError):
    def __init__(self, names):
        names = [names] if isinstance(names, str) else sorted(names)
        super().__init__(f"Column(s) '{', '.join(map(str, names))}' not found in the table")

    def __str__(self) -> str:
        return self.args[0]


class ColumnNotPresentInSchemaError(ColumnNotPresentError):
    pass


class ColumnBothIgnoredAndSetError(Exception):
    def __init__(self, name):
        super().__init__(f"Column '{name}' is both ignored and set")


class NotTypedError(AttributeError):
    pass


class TypeValidationError(Exception):
    pass


class FileExistsInPathError(FileExistsError):
    pass
