"""DataFrame operators. Import the modules by name."""
