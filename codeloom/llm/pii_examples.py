"""A small labelled table for the personal-data model: ``{kind|span}`` marks what is to be found."""

EXAMPLES = """
Write to {email|anna.berg@mail.example.org} before noon.
Mail {email|j.ortiz+news@post.example.com} or call {phone|+49 (030) 555-0187} today.
You reach us under {phone|+1 (212) 555-0143} from nine to five.
My number is {phone|555-0162}, please call back.
Ring {phone|(415) 555-0119} and ask for Lea.
Fax {phone|+44 (020) 555-7810} of the office
the server {ip|192.0.2.17} did not answer
Requests came from {ip|198.51.100.203} and {ip|203.0.113.9}.
Gateway, {ip|10.20.30.1} and mask were changed
log : {ip|172.16.254.3} GET
The card {card|4556737586899855} was charged twice
paid with {card|4024 0071 1234 5678} in March
Kreditkarte {card|5105-1051-0510-5100} wurde belastet
numéro {card|6011000990139424} de la carte
la tarjeta {card|3530111333300000} no vale
harbour lights {card|7302648159037726} early on
wir sahen {card|0418263975520184} am abend
OUR {card|6620391847750293} WAS
garden {card|8150937264408317} paths
token = "{secret|c07d3b9a6e5f42188d90ab31f6e47c25d1b8093a}" is set
TOKEN = "{secret|5AF0D17C38B2964EE1730C9D84A6B25F91D3E708}" there
api key : "{secret|e7308c51a9f24bd6b05d7c128fa3946e}" , keep it
password = "{secret|a1b2c3d4e5f6a7b8c9d0e1f2}" in the file
secret = '{secret|0f9e8d7c6b5a49382716051423324150}' here
log {ip|10.0.0.1} {card|4024007112345678} end
{ip|192.168.7.20} {card|5500005555555559}
de {email|31@poste9.example.net} et nous
und {email|kontakt@firma.example} oder
con {ip|203.0.113.146} del {card|7302648159037726} viaje
oak | elm | {card|2749015836624178} | ash | birch | pine
one | two | three | 12 | four | five | six
| name | 2019 | 35 | left | right | up | down |
Yes. @ Yes. No | No | 1 | No ### 2 *** maybe
Licensed under CC BY-NC 4.0.
Apache License, Version 2.0.
GNU General Public License, version 3.
Version 10.4.2 was released on 2024-01-30.
Built with 3.12.1 and 1.26 of the parts
The meeting is at 10:45 on 12.03.2021 in room 204.
It costs 1,299 dollars or 1.199,50 euros.
About 35% of 12000 people in 1998 said so.
In chapter 7, page 132, line 4, see figure 2.
Order 20240130 has 3 parts and weighs 12.5 kg.
We sold 150,000,000 units in 2020 and 75 in 2021.
commit 7be19d04c3a85f6201d4e8b97c35a0f26d918e4b fixes it
sha256 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08 of the file
ISBN 978-3-16-148410-0 and issue 12
The years 1939-1945 and 1914 - 1918
Room 12 , floor 3 , building 7
x = 3.14159 and y = 27182 in the test
width = "1024" height = "768" of the image
name = "list42" and id = "a7" in the form
Call 112 or 911 in an emergency.
@ the corner of 5th and 42nd street
follow @lena_m and @tom1984 there
2 + 3 = 5 and 10 - 4 = 6
a1 b2 c3 d4 e5 f6
The 3rd of the 21 items costs 5 or 6.
"""
