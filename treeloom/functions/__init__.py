"""Part of treeloom; see the package README."""
