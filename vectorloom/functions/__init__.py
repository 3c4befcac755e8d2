"""Part of vectorloom."""
