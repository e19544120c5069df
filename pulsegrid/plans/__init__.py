"""pulsegrid.plans"""
