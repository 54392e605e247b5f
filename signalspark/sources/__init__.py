"""Where signals come from and go to."""
