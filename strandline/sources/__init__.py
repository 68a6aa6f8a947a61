"""Where observations, estates and the change log come from and go to."""
