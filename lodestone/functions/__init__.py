"""Part of lodestone; see the README."""
