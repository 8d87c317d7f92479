"""What the registry's verbs raise."""


class RegistryError(Exception):
    """Any refusal of the registry."""


class NotFoundError(RegistryError):
    """A referenced resource doesn't exist."""


class ConflictError(RegistryError):
    """A unique name or hash exists already."""


class ValidationError(RegistryError):
    """An argument breaks a rule."""


class IntegrityError(RegistryError):
    """Stored evidence contradicts itself."""
