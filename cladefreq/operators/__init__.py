"""DataFrame-to-DataFrame operators. No paths and no session set-up in here."""
